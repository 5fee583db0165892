"""JSON found in free text, marked log lines, and JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.checks import without_descriptions, without_null
from attestra.sources.lines import RANGE_BYTES, lines, numbered


def repaired(text: Column) -> Column:
    """The JSON object that a text is, or that it fences, or that reaches from its first to its last brace; null if none of them parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parses = lambda c: F.try_parse_json(F.nullif(F.trim(c), F.lit(""))).isNotNull() & F.startswith(F.trim(c), F.lit("{"))
    return F.coalesce(*(F.when(parses(c), F.trim(c)) for c in (text, fenced, braced)))


def _last_object(text: str | None) -> str | None:
    found, depth, begin, quoted, escaped = None, 0, 0, False, False
    for k, c in enumerate(text or ""):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            begin, depth = (k if depth == 0 else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                found = text[begin : k + 1]
    return found


def last_object(text: Column) -> Column:
    """The last balanced object of a text; braces within strings don't count. Balance is beyond regular expressions, so batches go through Python."""

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(_last_object)

    return F.pandas_udf(find, "string")(text)


def json_lines(spark: SparkSession, path: str, schema: str, malformed: str = "fail", pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of JSON-lines files (a file or a folder), one for each line that isn't blank.

    malformed says what becomes of a line that is no JSON object: fail (the read fails and names the file and line of one), drop, or keep: all rows then have file, line, problem and malformed beside the record's own columns, and such a line has a problem, its text as malformed, and no record. A file is split into ranges for large ones; lines are read twice only where their numbers are asked for (keep and fail).
    """
    found = lines(spark, path, pattern, range_bytes)
    found = found if malformed == "drop" else numbered(found)
    found = found.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    bad = F.json_object_keys("text").isNull() | F.try_parse_json("text").isNull()
    record = F.from_json("text", schema)
    if malformed == "drop":
        return found.where(~bad).select(record.alias("r")).select("r.*")
    problem = F.when(bad, F.concat(F.lit("malformed line "), F.col("line"), F.lit(" of "), F.col("file")))
    if malformed == "keep":
        told = found.select("file", "line", problem.alias("problem"), F.when(bad, F.col("text")).alias("malformed"), F.when(~bad, record).alias("r"))
        return told.select("file", "line", "problem", "malformed", "r.*")
    if malformed != "fail":
        raise ValueError(f"unknown policy {malformed!r}")
    return found.select(F.when(bad, F.raise_error(problem).cast(found.select(record.alias("r")).schema["r"].dataType)).otherwise(record).alias("r")).select("r.*")


def marked_lines(log: DataFrame, marker: str, schema: str) -> DataFrame:
    """Records after a marker in the lines of a log, a table or a stream of lines: the others and what can't be read are skipped. Columns: those of the lines but text, and the record's."""
    others = [c for c in log.columns if c != "text"]
    found = log.where(F.contains("text", F.lit(marker))).select(*others, F.expr(f"substr(text, instr(text, '{marker}') + {len(marker)})").alias("json__"))
    readable = F.try_parse_json("json__").isNotNull()
    return found.where(readable).select(*others, F.from_json("json__", schema).alias("r__")).select(*others, "r__.*")


def named_texts(spark: SparkSession, path: str, name: str = "text", encoded: bool = False) -> DataFrame:
    """Whole files with their names without folder and ending; encoded: names are percent-encoded, as files_written() makes them."""
    slug = F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))  # Spark gives it as in a URI
    return spark.read.text(path, wholetext=True).select((F.url_decode(slug) if encoded else slug).alias("slug"), F.col("value").alias(name))


def truth_files(spark: SparkSession, truth: str, transcripts: str, excluded: DataFrame | None = None, key: str = "leaves") -> DataFrame:
    """slug, truth (JSON) and text of every `*.json` in a folder and the `*.txt` of its name (percent-encoded) in another, and problem: what keeps it from being graded (malformed, old format: without the key, no transcript), or null. excluded: slugs that are left out."""
    said = named_texts(spark, f"{truth}/*.json", "truth", encoded=True)
    said = said if excluded is None else said.join(excluded.select("slug"), "slug", "left_anti")
    both = said.join(named_texts(spark, f"{transcripts}/*.txt", encoded=True), "slug", "left")
    keys = F.json_object_keys("truth")
    problem = F.when(F.try_parse_json("truth").isNull() | keys.isNull(), "malformed").when(~F.array_contains(keys, key), "old format").when(F.col("text").isNull(), "no transcript")
    return both.select("slug", "truth", "text", problem.alias("problem"))


def loaded(results: DataFrame, slugs: DataFrame) -> DataFrame:
    """For every slug its result's JSON object, or what is wrong with it: absent, empty, malformed or no object."""
    joined = slugs.select("slug").join(results.select("slug", "text"), "slug", "left")
    parsed = F.try_parse_json("text")
    problem = (
        F.when(F.col("text").isNull(), "absent").when(F.trim("text") == "", "empty").when(parsed.isNull(), "malformed").when(~F.startswith(F.trim("text"), F.lit("{")), "no object")
    )
    return joined.withColumn("problem", problem).withColumn("fields", F.when(F.col("problem").isNull(), F.col("text"))).drop("text")


def _descriptions(node: object, out: dict[str, str]) -> dict[str, str]:
    if isinstance(node, dict):
        for name, field in (node.get("properties") or {}).items() if isinstance(node.get("properties"), dict) else ():
            if isinstance(field, dict) and isinstance(field.get("description"), str):
                out.setdefault(name, field["description"])
        for child in node.values():
            _descriptions(child, out)
    elif isinstance(node, list):
        for child in node:
            _descriptions(child, out)
    return out


def described(specs: DataFrame) -> DataFrame:
    """Names and descriptions of all properties in JSON schemas (doc, text), the first of each name."""

    def crawl(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, k, name, said) for doc, text in zip(pdf["doc"], pdf["text"], strict=True) for k, (name, said) in enumerate(_descriptions(json.loads(text), {}).items())]
            yield pd.DataFrame(rows, columns=["doc", "ord", "name", "description"])

    return specs.select("doc", "text").mapInPandas(crawl, f"doc {specs.schema['doc'].dataType.simpleString()}, ord long, name string, description string")


def _rewritten(specs: DataFrame, change: Callable[[object], object]) -> DataFrame:
    """JSON schemas (doc, text) after a change, written compactly with sorted names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[None if t is None else json.dumps(change(json.loads(t)), sort_keys=True, separators=(",", ":")) for t in pdf["text"]])

    return specs.select("doc", "text").mapInPandas(run, f"doc {specs.schema['doc'].dataType.simpleString()}, text string")


def undescribed(specs: DataFrame) -> DataFrame:
    """JSON schemas (doc, text) without their descriptions."""
    return _rewritten(specs, without_descriptions)


def unwrapped(specs: DataFrame) -> DataFrame:
    """JSON schemas (doc, text) whose values are what they are when they aren't null, with their outer descriptions."""
    return _rewritten(specs, without_null)
