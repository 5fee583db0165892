"""Rules over annotations, schemas, rules and events: each row with what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.strings import is_verbatim, padded_words

#: Statuses of an annotated field, and of a file's download.
TRUTH_STATUSES = ("unmentioned", "declared_absent", "asserted")
PROGRESS = ("initiate", "download", "progress", "done")


def truth_problems(truth: DataFrame) -> DataFrame:
    """Annotations (slug, path, kind, status, source_span, value, member, no_fit, options, alternatives, note, symmetric, text) with problems: an array of what breaks a rule, empty if nothing does."""
    c = F.col
    asserted, enum = c("status") == "asserted", c("kind") == "enum"
    valued = c("value").isNotNull() | c("member").isNotNull() | c("no_fit").isNotNull()
    place = lambda x: F.array_position("options", x)
    rules = [
        (~c("status").isin(*TRUTH_STATUSES) | c("status").isNull(), "unknown status"),
        ((c("status") == "unmentioned") & c("source_span").isNotNull(), "unmentioned with a span"),
        (c("status").isin("declared_absent", "asserted") & (F.coalesce(F.length("source_span"), F.lit(0)) == 0), "no span"),
        (enum & c("value").isNotNull(), "enum with a value"),
        (~enum & (c("member").isNotNull() | c("no_fit").isNotNull()), "member on another kind"),
        (asserted & (c("kind") == "number") & c("value").try_cast("double").isNull(), "no number"),
        (asserted & (c("kind") == "string") & (F.coalesce(F.length("value"), F.lit(0)) == 0), "no string"),
        (asserted & enum & (c("member").isNotNull() == c("no_fit").isNotNull()), "not one of member and no fit"),
        (asserted & enum & c("member").isNotNull() & ~F.array_contains("options", c("member")), "not a member"),
        (asserted & (c("no_fit") == ""), "no fit without a meaning"),
        (~asserted & valued, "a value that is not asserted"),
        ((F.size("alternatives") > 0) & (F.coalesce(F.length("note"), F.lit(0)) == 0), "alternatives without a note"),
        (enum & F.exists("alternatives", lambda x: ~F.array_contains("options", x)), "alternative not a member"),
        (c("symmetric") & ~enum, "symmetric on another kind"),
        (c("symmetric") & enum & (F.size("alternatives") == 0), "symmetric without alternatives"),
        (c("symmetric") & enum & F.exists("alternatives", lambda x: (place(x) > 0) & (place(x) < place(c("member")))), "member not the earliest"),
        (c("source_span").isNotNull() & ~is_verbatim(c("source_span"), c("text")), "span not in the text"),
    ]
    told = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in rules)))
    return truth.withColumn("problems", told)


def overlapping(disclaimers: DataFrame, members: DataFrame) -> DataFrame:
    """Paths that more than one disclaimer (slug, scope) covers, by the scopes' members (scope, path)."""
    return disclaimers.join(members, "scope").groupBy("slug", "path").agg(F.count("*").alias("n")).where("n > 1")


def scope_problem(kind: Column, name: Column, groups: list[str], sets: list[str]) -> Column:
    """What is wrong with a disclaimer's scope, or null."""
    return F.when((kind == "group") & ~F.coalesce(name.isin(*groups), F.lit(False)), "unknown group").when((kind == "set") & ~F.coalesce(name.isin(*sets), F.lit(False)), "unknown set").when(~kind.isin("group", "set", "unresolved") | kind.isNull(), "unknown scope")


def topic_mismatch(topic: Column, keywords: Column) -> Column:
    """Whether a topic has none of its scope's keywords, as whole words' beginnings; null where the scope has no keywords."""
    there = padded_words(topic)
    return F.when(F.size(keywords) > 0, ~F.exists(keywords, lambda k: F.contains(there, F.trim(padded_words(k)))))


def rule_applies(groups: Column, key: Column) -> Column:
    """A rule is for every group, or for those it lists."""
    return groups.isNull() | F.array_contains(groups, key)


def has_headroom(free: Column, needed: Column) -> Column:
    """Unknown stays unknown."""
    return free >= needed


def one_off(order: Column, a: Column, b: Column) -> Column:
    """Neighbours in an ordered vocabulary; what isn't in it is no neighbour."""
    x, y = F.array_position(order, a), F.array_position(order, b)
    return F.coalesce((x > 0) & (y > 0) & (F.abs(x - y) == 1), F.lit(False))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def progress(event: Column) -> Column:
    """A download's raw event (status, file, loaded, total) as one of the known stages, or null."""
    number = lambda c, on: F.when(on, F.coalesce(c, F.lit(0)))
    moving = event["status"] == "progress"
    return F.when(event["status"].isin(*PROGRESS), F.struct(event["status"].alias("stage"), F.coalesce(event["file"], F.lit("")).alias("file"), number(event["loaded"], moving).alias("loaded"), number(event["total"], moving).alias("total")))


def finish_problem(reason: Column) -> Column:
    """Why an answer can't be used; null for those that ended by themselves."""
    return F.when(reason == "length", "truncated").when(reason.isNotNull() & ~reason.isin("stop", ""), "filtered")


def error_class(kind: Column, http_status: Column) -> Column:
    """What to do after an error of a chat connector: terminal, retry or give up."""
    final = kind.isin("refusal", "unsupported")
    client = (kind == "http") & (http_status >= 400) & (http_status < 500) & ~http_status.isin(408, 429)
    return F.when(final, "terminal").when(F.coalesce(client, F.lit(False)), "dead").otherwise("retry")


def capability(has_cache: Column, has_gpu: Column, rtf: Column, cached: Column, slowest: float = 3.0) -> Column:
    """An engine's status and reason on a device."""
    say = lambda s, r=None: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    return F.when(~has_cache, say("unavailable", "no-cache")).when(~has_gpu, say("unavailable", "unsupported-platform")).when(F.coalesce(rtf > slowest, F.lit(False)), say("unavailable", "too-slow")).when(cached, say("ready")).otherwise(say("needs-download"))


def chunk_plan(n_samples: Column, window: int, n_regions: Column, rms: Column) -> Column:
    """How a recording is cut: not at all, by its regions, or by overlapping windows; silence gives nothing."""
    return F.when(n_samples <= 0, "none").when(n_samples <= window, "whole").when(n_regions > 0, "regions").when(rms < 1e-4, "none").otherwise("windows")


def split_by_group(schema: T.StructType) -> dict[str, T.StructType] | None:
    """One schema for each top-level group, or None if a field is no group."""
    if not all(isinstance(f.dataType, T.StructType) for f in schema.fields):
        return None
    return {f.name: T.StructType([f]) for f in schema.fields}


def without_descriptions(node: object) -> object:
    """A JSON schema without descriptions; a property of that name stays."""
    if isinstance(node, list):
        return [without_descriptions(x) for x in node]
    if not isinstance(node, dict):
        return node
    return {k: ({n: without_descriptions(x) for n, x in v.items()} if k == "properties" and isinstance(v, dict) else without_descriptions(v)) for k, v in node.items() if k != "description" or not isinstance(v, str)}


def without_null(node: object) -> object:
    """A JSON schema with every value that may be null (one of anyOf or oneOf, or of a list of types) as what it is otherwise. Of descriptions the outer one stays, as it was given last."""
    if isinstance(node, list):
        return [without_null(x) for x in node]
    if not isinstance(node, dict):
        return node
    node = {k: ({n: without_null(x) for n, x in v.items()} if k == "properties" and isinstance(v, dict) else without_null(v)) for k, v in node.items()}
    for key in ("anyOf", "oneOf"):
        others = [x for x in node[key] if x != {"type": "null"}] if isinstance(node.get(key), list) else []
        if len(others) == 1 and len(node[key]) > 1 and isinstance(others[0], dict):
            return others[0] | {k: v for k, v in node.items() if k != key}
    kinds = [x for x in node["type"] if x != "null"] if isinstance(node.get("type"), list) else []
    return node | {"type": kinds[0]} if len(kinds) == 1 else node


def declared(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the columns a schema declares, in its order."""
    return rows.select(*(f.name for f in schema.fields if f.name in rows.columns))
