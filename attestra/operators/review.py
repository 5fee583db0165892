"""Review of extracted fields: requests, decisions, and what they come to.

leaves: item_id, path, ord, value, confidence, source_span; decisions: item_id, path, status (accepted, edited or rejected), value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.numbers import clamped
from attestra.functions.strings import is_grounded
from attestra.sources.folders import written

ENVELOPE = T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("source_span", T.StringType())])


def enveloped(schema: T.StructType) -> T.StructType:
    """A schema of values with every leaf wrapped in an envelope; lists and maps as leaves are refused, and so are names with dots or of digits."""
    fields = []
    for f in schema.fields:
        if "." in f.name or f.name.isdigit():
            raise ValueError(f"{f.name!r} cannot be part of a path")
        if isinstance(f.dataType, T.StructType):
            fields.append(T.StructField(f.name, enveloped(f.dataType)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            raise ValueError(f"{f.name!r} is no single value")
        else:
            fields.append(T.StructField(f.name, T.StructType([T.StructField("value", f.dataType), *ENVELOPE.fields[1:]])))
    return T.StructType(fields)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of an enveloped schema's leaves, in their order."""
    out = []
    for f in schema.fields:
        leaf = {x.name for x in f.dataType.fields} == {"value", "confidence", "source_span"} if isinstance(f.dataType, T.StructType) else False
        out += [prefix + f.name] if leaf else leaf_paths(f.dataType, f"{prefix}{f.name}.")
    return out


def leaf_structs(column: str, schema: T.StructType) -> dict[str, Column]:
    """By path the leaves of an enveloped column (ord, path, value, confidence, source_span); a leaf that is missing has no value and confidence 0."""
    return {p: F.struct(F.lit(k).alias("ord"), F.lit(p).alias("path"), F.col(f"{column}.{p}.value").cast("string").alias("value"), F.coalesce(F.col(f"{column}.{p}.confidence"), F.lit(0.0)).alias("confidence"), F.col(f"{column}.{p}.source_span").alias("source_span")) for k, p in enumerate(leaf_paths(schema))}


def flattened(records: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One row for each record and leaf of its enveloped column, as leaf_structs has them."""
    return records.select(*(c for c in records.columns if c != column), F.explode(F.array(*leaf_structs(column, schema).values())).alias("leaf")).select(*(c for c in records.columns if c != column), "leaf.*")


def _kind(of: Column, key: str) -> Column:
    """The JSON kind of an object's member, as Spark names it: VOID for a null, null where there is none."""
    return F.schema_of_variant(F.variant_get(of, f"$.{key}", "variant"))


def _envelope(node: Column) -> Column:
    """An envelope from a parsed object; whatever is no whole envelope reads as a leaf that was left out."""
    whole = F.coalesce(F.regexp_like(_kind(node, "confidence"), F.lit("^(BIGINT|DOUBLE|DECIMAL)")) & _kind(node, "sourceSpan").isin("STRING", "VOID"), F.lit(False))
    return F.struct(
        F.when(whole, F.try_variant_get(node, "$.value", "string")).alias("value"), F.when(whole, clamped(F.try_variant_get(node, "$.confidence", "double"))).otherwise(0.0).alias("confidence"),
        F.when(whole, F.try_variant_get(node, "$.sourceSpan", "string")).alias("source_span"),
    )


def read_envelope(json: Column) -> Column:
    """An envelope (value, a number as confidence, a string or null as sourceSpan) from JSON, its value as text and its confidence clamped. It is read as a whole or not at all: what is malformed reads as a leaf left out, without value and quote, of confidence 0."""
    return _envelope(F.try_parse_json(json))


def request(leaves: DataFrame, texts: DataFrame) -> DataFrame:
    """leaves with grounded (does the item's text have the quote) and state: stated, addressed (no value, but a quote) or silent."""
    state = F.when(F.col("value").isNotNull(), "stated").when(F.col("source_span").isNotNull(), "addressed").otherwise("silent")
    return leaves.join(texts.select("item_id", "text"), "item_id", "left").withColumn("grounded", is_grounded(F.col("source_span"), F.coalesce("text", F.lit("")))).withColumn("state", state).drop("text")


def completeness(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    """Paths without a decision (missing), and decisions without a path (extra)."""
    key = ["item_id", "path"]
    both = leaves.select(*key, F.lit(True).alias("leaf__")).join(decisions.select(*key, F.lit(True).alias("decided__")), key, "full")
    lone = both.where("leaf__ IS NULL OR decided__ IS NULL")
    return lone.select(*key, F.when(F.col("decided__").isNull(), "missing").otherwise("extra").alias("issue"))


def untouched(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    return leaves.join(decisions.select("item_id", "path"), ["item_id", "path"], "left_anti")


def blocked(requested: DataFrame, decisions: DataFrame) -> DataFrame:
    """Undecided leaves that no quote grounds: they hold back a submission."""
    return untouched(requested, decisions).where("NOT grounded")


def with_defaults(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision for every leaf: accepted where none was made."""
    said = decisions.select("item_id", "path", F.col("status").alias("said"), F.col("value").alias("edit"))
    joined = leaves.join(said, ["item_id", "path"], "left")
    return joined.select("item_id", "path", F.coalesce("said", F.lit("accepted")).alias("status"), F.col("edit").alias("value"))


def resolved(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    """The leaves that stay, with their values: rejected ones go, edited ones are replaced. issue tells edits without a value."""
    said = decisions.select("item_id", "path", "status", F.col("value").alias("edit"))
    joined = leaves.join(said, ["item_id", "path"], "left").where("coalesce(status, 'accepted') != 'rejected'")
    edited = F.coalesce(F.col("status") == "edited", F.lit(False))
    return joined.withColumn("value", F.when(edited, F.col("edit")).otherwise(F.col("value"))).withColumn("issue", F.when(edited & F.col("edit").isNull(), "edit without a value")).drop("edit", "status")


def _outcome() -> Column:
    return F.when(F.size("rejected_fields") == F.col("n"), "discarded").when(F.size("edited_fields") + F.size("rejected_fields") > 0, "edited").otherwise("accepted")


def outcomes(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    """By item: accepted, edited or discarded (nothing stays), with the paths that were edited and rejected."""
    said = leaves.join(decisions.select("item_id", "path", "status"), ["item_id", "path"], "left")
    lists = said.groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "edited", F.col("path")))).alias("edited_fields"), F.array_sort(F.collect_list(F.when(F.col("status") == "rejected", F.col("path")))).alias("rejected_fields"), F.count("*").alias("n"))
    return lists.withColumn("status", _outcome()).drop("n")


class Tally:
    """What was decided, counted by item: for records that come with their decisions, so that no leaf has to look for its own.

    records: each row is a record (item_id, never null) with every path of statuses as a leaf; statuses: by path the status of its decision, null where there is none; others: how many decisions a record has for paths it lacks. One row of counts for each record is exchanged. Records of one item_id count as outcomes and completeness would join them: each decision of one is for the leaves of all.
    """

    def __init__(self, records: DataFrame, statuses: dict[str, Column], others: Column):
        self.paths = sorted(statuses)
        flags = [test(statuses[p]).cast("long").alias(f"{name}{k}") for k, p in enumerate(self.paths) for name, test in (("decided", lambda s: s.isNotNull()), ("edited", lambda s: s.eqNullSafe("edited")), ("rejected", lambda s: s.eqNullSafe("rejected")))]
        marked = records.select("item_id", *flags, others.cast("long").alias("others"))
        self.items = marked.groupBy("item_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in marked.columns[1:]))

    def outcomes(self) -> DataFrame:
        """As outcomes has them."""
        def listed(name: str) -> Column:
            return F.flatten(F.array(*(F.array_repeat(F.lit(p), (F.col("n") * F.col(f"{name}{k}")).cast("int")) for k, p in enumerate(self.paths))))

        joined = sum((F.greatest(F.col(f"decided{k}"), F.lit(1)) for k in range(len(self.paths))), F.lit(0)) * F.col("n")
        lists = self.items.select("item_id", listed("edited").alias("edited_fields"), listed("rejected").alias("rejected_fields"), joined.alias("n"))
        return lists.withColumn("status", _outcome()).drop("n")

    def conformant(self) -> DataFrame:
        """item_id, and whether each of its paths has a decision and each decision a path."""
        whole = F.col("others") == 0
        for k in range(len(self.paths)):
            whole &= F.col(f"decided{k}") > 0
        return self.items.select("item_id", whole.alias("conformant"))


def nested(leaves: DataFrame, schema: T.StructType) -> DataFrame:
    """Leaves back as one nested record for each item, fields in the schema's order."""
    paths = leaf_paths(schema)
    wide = leaves.groupBy("item_id").pivot("path", paths).agg(F.first("value"))

    def build(s: T.StructType, prefix: str = "") -> list[Column]:
        return [F.col(f"`{prefix}{f.name}`").alias(f.name) if prefix + f.name in paths else F.struct(*build(f.dataType, f"{prefix}{f.name}.")).alias(f.name) for f in s.fields]

    return wide.select("item_id", F.struct(*build(schema)).alias("fields"))


def grouped_paths(leaves: DataFrame) -> DataFrame:
    """Groups, by the paths' first part, in the order in which they first appear."""
    return leaves.groupBy(F.substring_index("path", ".", 1).alias("group")).agg(F.min("ord").alias("first"), F.count_distinct("path").alias("n_paths"))


def first_issues(issues: DataFrame) -> DataFrame:
    """Of each path the message that came first (path, ord, message)."""
    return issues.groupBy("path").agg(F.min_by("message", "ord").alias("message"))


def missing_keys(json: Column, keys: list[str]) -> Column:
    """Of those keys, the ones that a JSON object lacks."""
    return F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(json), F.expr("CAST(array() AS array<string>)")))


def extra_keys(json: Column, keys: list[str]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(json), F.expr("CAST(array() AS array<string>)")), F.array(*map(F.lit, keys)))


_KEYS = ("value", "sourceSpan", "confidence")


def loose_leaves(records: DataFrame, json: str) -> DataFrame:
    """Leaves of JSON without a schema: whatever has a value, a sourceSpan and a confidence is a leaf, any other object or list is gone into, as deep as it goes. Columns: the others, path (list items by their number from 0), value (as text), confidence (clamped to 0..1; 0 if it is no number) and source_span; what is neither object nor list gives nothing.

    A level of all records is one job; what is found and what is to be gone into are written, so that no level is walked twice.
    """
    others = [c for c in records.columns if c != json]
    level = records.select(*others, F.lit(None).cast("string").alias("path__"), F.try_parse_json(json).alias("node__"))
    found = []
    while True:
        inner = records.sparkSession.sql(f"SELECT {', '.join(f't.`{c}`' for c in others)}, t.path__, e.* FROM {{t}} AS t, LATERAL variant_explode(t.node__) AS e", t=level)
        leaf = F.size(F.array_compact(F.array(*(_kind(F.col("value"), k) for k in _KEYS)))) == len(_KEYS)
        kept = inner.select(*others, F.concat_ws(".", "path__", F.coalesce("key", F.col("pos").cast("string"))).alias("path__"), F.col("value").alias("node__"), F.coalesce(leaf, F.lit(False)).alias("leaf__"), F.schema_of_variant("value").alias("kind__"))
        here = written(kept.where(F.col("leaf__") | F.regexp_like("kind__", F.lit("^(OBJECT|ARRAY)"))).drop("kind__"))
        found.append(here.where("leaf__"))
        level = here.where("NOT leaf__").drop("leaf__")
        if level.isEmpty():
            break
    node, whole = F.col("node__"), found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    confidence = clamped(F.coalesce(F.when(F.regexp_like(_kind(node, "confidence"), F.lit("^(BIGINT|DOUBLE|DECIMAL)")), F.try_variant_get(node, "$.confidence", "double")), F.lit(0.0)))
    return whole.select(*others, F.col("path__").alias("path"), F.try_variant_get(node, "$.value", "string").alias("value"), confidence.alias("confidence"), F.try_variant_get(node, "$.sourceSpan", "string").alias("source_span"))


def parsed(json: Column, schema: T.StructType, context: Column) -> Column:
    """A struct of the fields, if the JSON is an object with exactly a schema's keys and their kinds, and error: what is wrong, where."""
    names = [f.name for f in schema.fields]
    keys, got = F.json_object_keys(json), F.from_json(json, schema)
    lacking, odd = missing_keys(json, names), extra_keys(json, names)
    wrong = F.array_compact(F.array(*(F.when(F.get_json_object(json, f"$.{f.name}").isNotNull() & got[f.name].isNull(), f.name) for f in schema.fields)))
    problem = F.when(keys.isNull(), "no JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", "))).when(F.size(odd) > 0, F.concat(F.lit("unknown "), F.array_join(odd, ", "))).when(F.size(wrong) > 0, F.concat(F.lit("wrong kind of "), F.array_join(wrong, ", ")))
    return F.struct(F.when(problem.isNull(), got).alias("fields"), F.concat(context, F.lit(": "), problem).alias("error"))
