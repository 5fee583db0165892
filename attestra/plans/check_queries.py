"""Rules and callers' functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.strings import phrases
from attestra.operators import checks as K
from attestra.operators import extraction as X
from attestra.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'enum' END AS kind, (['unmentioned', 'declared_absent', 'asserted', 'asserted', 'odd'])[CAST(l_suppkey % 5 + 1 AS INT)] AS status, CASE WHEN l_linenumber < 6 THEN 'line ' || l_linenumber WHEN l_linenumber = 6 THEN '' END AS span,
  CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE '5' END WHEN l_partkey % 3 = 1 AND l_partkey % 5 <> 0 THEN 'v' END AS value, CASE WHEN l_partkey % 3 = 2 THEN l_returnflag END AS member, CASE WHEN l_partkey % 3 = 2 AND l_partkey % 7 = 0 THEN '' END AS no_fit FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, k, l_suppkey, list_filter([CASE WHEN status = 'odd' THEN 'unknown status' END, CASE WHEN status = 'unmentioned' AND span IS NOT NULL THEN 'unmentioned with a span' END, CASE WHEN status IN ('declared_absent', 'asserted') AND coalesce(length(span), 0) = 0 THEN 'no span' END,
  CASE WHEN status = 'asserted' AND kind = 'number' AND try_cast(value AS DOUBLE) IS NULL THEN 'no number' END, CASE WHEN status = 'asserted' AND kind = 'string' AND coalesce(length(value), 0) = 0 THEN 'no string' END, CASE WHEN status = 'asserted' AND kind = 'enum' AND no_fit IS NOT NULL THEN 'not one of member and no fit' END,
  CASE WHEN status = 'asserted' AND kind = 'enum' AND member = 'R' THEN 'not a member' END, CASE WHEN status = 'asserted' AND no_fit = '' THEN 'no fit without a meaning' END, CASE WHEN status <> 'asserted' AND (value IS NOT NULL OR member IS NOT NULL OR no_fit IS NOT NULL) THEN 'a value that is not asserted' END,
  CASE WHEN span IS NOT NULL AND (span = '' OR l_linenumber = 5) THEN 'span not in the text' END], lambda x: x IS NOT NULL) AS problems FROM t) SELECT * FROM p""")
def prj_truth_problems(spark, sf_dir):
    """PRJ-24, PRJ-26, PRJ-27, LST-23."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(k % 3 == 0, "number").when(k % 3 == 1, "string").otherwise("enum")
    status = F.element_at(F.array(*map(F.lit, ("unmentioned", "declared_absent", "asserted", "asserted", "odd"))), (F.col("l_suppkey") % 5).cast("int") + 1)
    value = F.when(k % 3 == 0, F.when(k % 4 == 0, "x").otherwise("5")).when((k % 3 == 1) & (k % 5 != 0), "v")
    none = F.array().cast("array<string>")
    truth = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", k.alias("k"), "l_suppkey", kind.alias("kind"), status.alias("status"), F.when(n < 6, F.concat(F.lit("line "), n)).when(n == 6, "").alias("source_span"), value.alias("value"), F.when(k % 3 == 2, F.col("l_returnflag")).alias("member"), F.when((k % 3 == 2) & (k % 7 == 0), "").alias("no_fit"),
        F.array(F.lit("A"), F.lit("N")).alias("options"), none.alias("alternatives"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("symmetric"), F.lit("line 1, line 2, line 3 and line 4").alias("text"),
    )
    return K.truth_problems(truth).select("l_orderkey", "l_linenumber", "k", "l_suppkey", "problems")


@query("""SELECT o_orderkey AS slug, n AS path, count(*) AS n FROM (SELECT o_orderkey, unnest([o_custkey % 6, o_custkey % 6 + 1, o_custkey % 5, o_custkey % 5 + 1]) AS n FROM orders) GROUP BY ALL HAVING count(*) > 1""")
def prj_overlapping_disclaimers(spark, sf_dir):
    """PRJ-15, PRJ-27."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.explode(F.array(F.col("o_custkey") % 6, F.col("o_custkey") % 5)).alias("scope"))
    members = spark.range(7).select(F.col("id").alias("scope"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("path"))
    return K.overlapping(o, members)


@query("""WITH k AS (SELECT p_partkey AS part, p_size AS s, * FROM part) SELECT part, CASE s % 4 WHEN 0 THEN CASE WHEN s % 3 <> 0 THEN 'unknown group' END WHEN 1 THEN CASE WHEN s % 5 <> 0 THEN 'unknown set' END WHEN 3 THEN 'unknown scope' END AS scope_problem,
  CASE WHEN s % 6 <> 0 THEN NOT contains(p_name, 'ring') AND NOT contains(lower(p_type), 'econ') END AS mismatch, s % 5 = 0 OR s % 5 = 1 AS applies, CASE WHEN s % 7 <> 0 THEN p_retailprice >= 1000 END AS headroom,
  s BETWEEN 1 AND 10 AS near_band, starts_with(p_type, 'E') OR starts_with(p_type, 'SM') AS chosen, CASE s % 5 WHEN 0 THEN 'initiate' WHEN 1 THEN 'progress' WHEN 2 THEN 'done' END AS stage, CASE s % 5 WHEN 1 THEN s END AS loaded,
  CASE s % 4 WHEN 1 THEN 'truncated' WHEN 2 THEN 'filtered' END AS finish, CASE WHEN s % 3 = 0 THEN 'terminal' WHEN s % 3 = 1 AND s % 2 = 0 THEN 'dead' ELSE 'retry' END AS after_error,
  CASE WHEN s % 11 = 0 OR s % 7 = 0 OR s > 40 THEN 'unavailable' WHEN s % 2 = 0 THEN 'ready' ELSE 'needs-download' END AS status, CASE WHEN s % 11 = 0 THEN 'no-cache' WHEN s % 7 = 0 THEN 'unsupported-platform' WHEN s > 40 THEN 'too-slow' END AS reason,
  CASE WHEN s <= 2 THEN 'none' WHEN s <= 12 THEN 'whole' WHEN s % 3 = 0 THEN 'regions' WHEN s % 5 = 0 THEN 'none' ELSE 'windows' END AS plan, CASE WHEN s % 2 = 0 THEN [p_name] END AS phrases FROM k""")
def prj_rules(spark, sf_dir):
    """PRJ-20, 28, 29, 36, 37, WIN-15, STR-27, STR-28, LST-19, UDF-08, 09, 21, 23, MTH-13."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("group", "set", "unresolved", "other"))), (s % 4).cast("int") + 1)
    name = F.when((kind == "group") & (s % 3 == 0), "attic").when((kind == "set") & (s % 5 == 0), "shell").otherwise("else")
    order = F.array(*map(F.lit, ("0", "1-10", "11-20")))
    stage = F.when(s % 5 == 0, "initiate").when(s % 5 == 1, "progress").when(s % 5 == 2, "done").otherwise("odd")
    event = F.struct(stage.alias("status"), F.lit("f").alias("file"), s.alias("loaded"), s.alias("total"))
    can = K.capability(s % 11 != 0, s % 7 != 0, s / 40 * 3, s % 2 == 0)
    return p.select(
        F.col("p_partkey").alias("part"), K.scope_problem(kind, name, ["attic"], ["shell"]).alias("scope_problem"), K.topic_mismatch(F.concat_ws(" ", "p_name", "p_type"), F.when(s % 6 != 0, F.array(F.lit("ring"), F.lit("econ"))).otherwise(F.array().cast("array<string>"))).alias("mismatch"),
        K.rule_applies(F.when(s % 5 != 0, F.array(s % 5)), F.lit(1)).alias("applies"), K.has_headroom(F.when(s % 7 != 0, F.col("p_retailprice")), F.lit(1000.0)).alias("headroom"),
        K.one_off(order, F.when((s >= 1) & (s <= 10), "1-10").otherwise("Don't Know"), F.lit("0")).alias("near_band"), K.starts_with_any(F.col("p_type"), ["E", "SM"]).alias("chosen"),
        K.progress(event)["stage"].alias("stage"), K.progress(event)["loaded"].alias("loaded"), K.finish_problem(F.when(s % 4 == 1, "length").when(s % 4 == 2, "content_filter").when(s % 4 == 3, "stop")).alias("finish"),
        K.error_class(F.when(s % 3 == 0, "refusal").when(s % 3 == 1, "http").otherwise("transport"), F.when(s % 2 == 0, 404).otherwise(503)).alias("after_error"), can["status"].alias("status"), can["reason"].alias("reason"),
        K.chunk_plan(s - 2, 10, F.when(s % 3 == 0, 2).otherwise(0), F.when(s % 5 == 0, 0.0).otherwise(0.1)).alias("plan"), phrases(F.when(s % 2 == 0, F.array(F.concat(F.lit(" "), F.col("p_name")), F.lit(" "))).otherwise(F.array(F.lit("  ")))).alias("phrases"),
    )


def _double(text: str, group: str) -> dict:
    if group == "marks" and len(text) % 7 == 0:
        raise ValueError("no marks")
    return {group: len(text) if group == "length" else text.count(".")}


@query("""SELECT doc_id AS item_id, CASE WHEN length(text) % 7 <> 0 THEN length(text) END AS length, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: no marks' END AS error FROM documents""")
def stm_extraction_by_group(spark, sf_dir):
    """STM-29, STM-30, UDF-02, 03, 07, 10, 14, 27, SET-01: a deterministic double in the extractor's place."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    found = X.merged(X.per_group(texts, X.Target(("length", "marks")), _double))
    return found.select("item_id", F.get_json_object(F.try_element_at("fields", F.lit("length")), "$.length").cast("bigint").alias("length"), "error")


@query("""SELECT conv_id AS item_id, string_agg(substr(text, 1, 5), ' ' ORDER BY turn) FILTER (trim(substr(text, 1, 5)) <> '') AS text FROM conversations GROUP BY conv_id""")
def stm_transcription_by_chunk(spark, sf_dir):
    """STM-34, UDF-01, 15, 22."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ord"), F.col("text").cast("binary").alias("audio"))
    return X.transcribed(chunks, lambda audio: audio.decode()[:5])


@query("""SELECT DISTINCT ON (o_custkey) o_custkey AS idempotency_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)""")
def src_written_once(spark, sf_dir):
    """SRC-43: what a sink may send, once for each key and not what it has sent before."""
    from attestra.sources.outbox import written_once

    writes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("idempotency_key"))
    return written_once(writes, table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("idempotency_key"))).select("idempotency_key")
