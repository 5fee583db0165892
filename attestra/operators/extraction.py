"""Running callers' own extractors and transcribers over tables.

An extractor takes a text (and a group of fields) and gives a dictionary; a transcriber takes bytes and gives a text. They are plain functions, run in Python workers batch by batch; a failure becomes a row, not the job's end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[str, str], dict]
Transcriber = Callable[[bytes], str]


@dataclass(frozen=True)
class Target:
    """What to extract: groups of fields, the system's instructions, and examples (text, fields) to show."""

    groups: tuple[str, ...]
    instructions: str = ""
    examples: tuple[tuple[str, dict], ...] = ()
    group_instructions: dict[str, str] = field(default_factory=dict)


def messages(target: Target, text: str, group: str | None = None) -> list[dict]:
    """The conversation to send: instructions, each example as a turn of its own, and the text; with a group only what concerns it."""
    said = target.instructions if group is None else "\n".join(filter(None, [target.instructions, target.group_instructions.get(group)]))
    out = [{"role": "system", "content": said}]
    for shown, fields in target.examples:
        part = fields if group is None else {group: fields[group]} if group in fields else None
        if part is not None:
            out += [{"role": "user", "content": shown}, {"role": "assistant", "content": json.dumps(part, sort_keys=True)}]
    return [*out, {"role": "user", "content": text}]


def _attempted(call: Callable[[], dict], attempts: int) -> tuple[str | None, str | None, int]:
    error = None
    for n in range(1, attempts + 1):
        try:
            return json.dumps(call(), sort_keys=True), None, n
        except Exception as e:  # noqa: BLE001  a caller's function may raise anything; the row says what
            error = f"{type(e).__name__}: {e}"
            if getattr(e, "terminal", False):
                return None, error, n
    return None, error, attempts


def per_group(texts: DataFrame, target: Target, extractor: Extractor, attempts: int = 3, tasks: int | None = None) -> DataFrame:
    """item_id, group, fields (JSON or null), error and attempts: every text with every group. tasks bounds how many calls run at a time."""
    spread = texts.select("item_id", F.col("text").cast("string").alias("text")).withColumn("group", F.explode(F.array(*map(F.lit, target.groups))))
    spread = spread if tasks is None else spread.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, g, *_attempted(lambda t=t, g=g: extractor(t, g), attempts)) for i, t, g in zip(pdf["item_id"], pdf["text"], pdf["group"], strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "group", "fields", "error", "attempts"])

    return spread.mapInPandas(run, f"item_id {texts.schema['item_id'].dataType.simpleString()}, group string, fields string, error string, attempts int")


def merged(parts: DataFrame) -> DataFrame:
    """One row for each item: its groups' fields by group, or the first group's error."""
    lists = parts.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("fields").isNotNull(), F.struct("group", "fields"))))).alias("fields"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("group"))).alias("error"))
    return lists.withColumn("fields", F.when(F.col("error").isNull(), F.col("fields")))


def single_shot(texts: DataFrame, target: Target, extractor: Extractor, attempts: int = 3) -> DataFrame:
    """item_id, fields, error: every text in one call."""
    return per_group(texts, Target(("",), target.instructions, target.examples), extractor, attempts).select("item_id", "fields", "error", "attempts")


def transcribed(chunks: DataFrame, transcriber: Transcriber) -> DataFrame:
    """item_id and text of recordings in chunks (item_id, ord, audio): each chunk's text, those that aren't blank joined in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["item_id", "ord"]].assign(text=[transcriber(bytes(x)) for x in pdf["audio"]])

    kind = chunks.schema["item_id"].dataType.simpleString()
    texts = chunks.select("item_id", "ord", "audio").mapInPandas(run, f"item_id {kind}, ord long, text string")
    pieces = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", "text"))))
    return texts.groupBy("item_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), " ").alias("text"))


def extractor_for(key: str | None, one_call: bool, double: Extractor, real: Extractor) -> tuple[str, Extractor]:
    """Which way to extract: without a key the double; else by group, or all in one call."""
    return ("double", double) if not key else ("single-shot" if one_call else "per-group", real)


def instructions(rules: Column, preamble: str, base_heading: str, further_heading: str, output: str, marker: str, last_base: int = 6) -> Column:
    """Instructions from rules (an array of number and text): those up to last_base under one heading, the others, if there are any, under another; then what to put out, and last the marker that the text follows."""
    texts = lambda keep: F.array_join(F.transform(F.array_sort(F.filter(rules, lambda r: keep(r["number"]))), lambda r: r["text"]), "\n\n")
    more = texts(lambda n: n > last_base)
    return F.concat(F.lit(preamble + base_heading), texts(lambda n: n <= last_base), F.when(more != "", F.concat(F.lit(further_heading), more)).otherwise(""), F.lit(output + marker))


def conversation(said: Column, examples: Column, text: Column, group: Column | None = None) -> Column:
    """The conversation to send, as an array of role and content: instructions, each example (text, fields: a map from group to JSON) as a turn of its own, and the text. With a group, examples show only its fields, and those that lack it are left out."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if group is None:
        shown = F.transform(examples, lambda e: F.struct(e["text"].alias("text"), F.to_json(e["fields"]).alias("fields")))
    else:
        own = F.filter(examples, lambda e: F.map_contains_key(e["fields"], group))
        shown = F.transform(own, lambda e: F.struct(e["text"].alias("text"), F.to_json(F.map_filter(e["fields"], lambda k, _: k == group)).alias("fields")))
    turns = F.flatten(F.transform(shown, lambda e: F.array(turn("user", e["text"]), turn("assistant", e["fields"]))))
    return F.concat(F.array(turn("system", said)), turns, F.array(turn("user", text)))


def canned(recordings: DataFrame, answers: DataFrame, key: str, text: str, default: str) -> DataFrame:
    """A double's answers: of each recording the canned text for its key, else the default."""
    return recordings.select(key).join(answers.select(key, text), key, "left").select(key, F.coalesce(text, F.lit(default)).alias(text))


def described_fields(fields: DataFrame, vendor: DataFrame, key: str, theirs: str, own: str) -> DataFrame:
    """key and description: what the vendor says of a field, where it says something, and the own note."""
    both = fields.select(key, own).join(vendor.select(key, theirs), key, "left")
    return both.select(key, F.concat_ws(" ", theirs, own).alias("description"))


def recording_totals(segments: DataFrame, by: str) -> DataFrame:
    """By recording group of segments (duration, elapsed, duty): n_segments, duration, rtf (all time taken over all time recorded) and the mean duty of those that have one."""
    duration = F.sum("duration")
    return segments.groupBy(by).agg(F.count("*").alias("n_segments"), duration.alias("duration"), F.try_divide(F.sum("elapsed"), duration).alias("rtf"), F.avg("duty").alias("duty"))


def measured_rtf(verdict: Column) -> Column:
    """The real-time factor of a stored verdict (JSON), a number; what is malformed was not measured."""
    found = F.try_variant_get(F.try_parse_json(verdict), "$.rtf", "double")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(verdict), "$.rtf", "variant"))
    return F.when(F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE)")), found)
