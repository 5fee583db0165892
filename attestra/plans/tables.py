"""The driver's tables in the roles of the engine's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.operators.queue import STATUSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as queue items; device stands for whose queue it is."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), k.alias("seq"), F.element_at(F.array(*map(F.lit, STATUSES)), (k % 10).cast("int") + 1).alias("status"), (k % 9).cast("int").alias("attempts"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("next_attempt_at"), F.col("o_totalprice").cast("long").alias("duration_ms"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("transcript"), F.when(k % 4 == 0, F.col("o_orderstatus")).alias("extracted"), (F.col("o_custkey") % 20).alias("device"),
    )


QUEUE = f"""q AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, ({list(STATUSES)})[CAST(o_orderkey % 10 AS INT) + 1] AS status, CAST(o_orderkey % 9 AS INT) AS attempts,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS next_attempt_at, CAST(trunc(o_totalprice) AS BIGINT) AS duration_ms,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS transcript, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS extracted, o_custkey % 20 AS device FROM orders)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of each user in order as frames; p is the value's share of 100, at most 1."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.least(F.lit(1.0), F.col("value") / 100).alias("p"))


FRAMES = "f AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(1.0, value / 100) AS p FROM events)"

QUOTE_KINDS = 6


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document a quote: verbatim, in capitals, without marks, from another place, blank or none."""
    k, t = F.col("doc_id") % QUOTE_KINDS, F.col("text")
    cut = F.substring(t, 5, 60)
    span = F.when(k == 0, cut).when(k == 1, F.translate(cut, "aeinrst", "AEINRST")).when(k == 2, F.regexp_replace(cut, "[.,]", "")).when(k == 3, F.concat(cut, F.lit(" and nothing of the kind"))).when(k == 4, "  ")
    return table(spark, sf_dir, "documents").select("doc_id", "text", span.alias("span"))


QUOTES = """s AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN substr(text, 5, 60) WHEN 1 THEN translate(substr(text, 5, 60), 'aeinrst', 'AEINRST') WHEN 2 THEN regexp_replace(substr(text, 5, 60), '[.,]', '', 'g')
  WHEN 3 THEN substr(text, 5, 60) || ' and nothing of the kind' WHEN 4 THEN '  ' END AS span FROM documents)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as judged fields: the order is the record, the line the field; some values dropped, changed or made up."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.element_at(F.array(F.lit("number"), F.lit("string"), F.lit("enum")), (n % 3 + 1).cast("int"))
    health = n == 5
    value = F.when(kind == "number", F.col("l_quantity").cast("int").cast("string")).when(health, F.when(k % 2 == 0, "Passed").when(k % 7 == 1, "Not Tested").otherwise("Failed")).when(kind == "string", F.concat(F.col("l_returnflag"), F.lit(" - "), F.col("l_linestatus"), F.col("l_returnflag"))).otherwise(F.col("l_returnflag"))
    other = F.when(kind == "number", F.when(k % 11 == 4, "many").otherwise(F.col("l_suppkey").cast("string"))).when(health, F.when(k % 3 == 0, "Passed").when(k % 7 == 1, "Not Tested").otherwise("Warning")).when(kind == "string", F.lower(value)).otherwise(F.col("l_linestatus"))
    said = F.when(k % 5 == 1, None).when(k % 4 == 1, other).otherwise(value)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("slug"), F.concat(F.lit("group."), F.lit("leaf"), n.cast("string")).alias("path"), kind.alias("kind"), health.alias("is_health"), (n == 4).alias("is_band"),
        F.when(k % 6 != 2, value).alias("truth"), said.alias("value"), F.when(said.isNotNull() & (k % 8 != 3), F.concat(F.lit("It was "), said)).alias("source_span"),
        F.when(k % 9 == 4, F.array(other)).otherwise(F.array().cast("array<string>")).alias("alternatives"), F.when(k % 10 == 9, F.array(other)).otherwise(F.array().cast("array<string>")).alias("retracted"),
        (k % 12 == 1).alias("acceptable_miss"), F.concat(F.lit("it was "), F.coalesce(said, F.lit("")), F.lit(", they said.")).alias("text"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )


CELLS = """c1 AS (SELECT *, l_linenumber AS n, l_partkey AS k, (['number', 'string', 'enum'])[CAST(l_linenumber % 3 + 1 AS INT)] AS kind, l_linenumber = 5 AS is_health FROM lineitem),
c2 AS (SELECT *, CASE WHEN kind = 'number' THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN is_health THEN CASE WHEN k % 2 = 0 THEN 'Passed' WHEN k % 7 = 1 THEN 'Not Tested' ELSE 'Failed' END WHEN kind = 'string' THEN l_returnflag || ' - ' || l_linestatus || l_returnflag ELSE l_returnflag END AS v FROM c1),
c3 AS (SELECT *, CASE WHEN kind = 'number' THEN CASE WHEN k % 11 = 4 THEN 'many' ELSE CAST(l_suppkey AS VARCHAR) END WHEN is_health THEN CASE WHEN k % 3 = 0 THEN 'Passed' WHEN k % 7 = 1 THEN 'Not Tested' ELSE 'Warning' END WHEN kind = 'string' THEN lower(v) ELSE l_linestatus END AS o FROM c2),
c4 AS (SELECT *, CASE WHEN k % 5 = 1 THEN NULL WHEN k % 4 = 1 THEN o ELSE v END AS said FROM c3),
c5 AS (SELECT CAST(l_orderkey AS VARCHAR) AS slug, 'group.leaf' || n AS path, kind, is_health, n = 4 AS is_band, CASE WHEN k % 6 <> 2 THEN v END AS truth, said AS value,
  CASE WHEN said IS NOT NULL AND k % 8 <> 3 THEN 'It was ' || said END AS source_span, CASE WHEN k % 9 = 4 THEN o END AS alternative, CASE WHEN k % 10 = 9 THEN o END AS taken_back, k % 12 = 1 AS acceptable_miss,
  'it was ' || coalesce(said, '') || ', they said.' AS text, l_discount * 10 AS confidence, l_partkey AS part, l_suppkey AS supplier FROM c4)"""


def equal_sql(a: str, b: str) -> str:
    x, y = (f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')" for c in (a, b))
    number = f"coalesce(abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) <= greatest(1e-9, 1e-6 * greatest(abs(try_cast({a} AS DOUBLE)), abs(try_cast({b} AS DOUBLE)))), false)"
    return f"(CASE kind WHEN 'number' THEN {number} WHEN 'string' THEN ({x} = {y} OR (length({x}) > 2 AND length({y}) > 2 AND (contains({x}, {y}) OR contains({y}, {x})))) ELSE {a} = {b} END)"


VERDICTS = CELLS + f""", c6 AS (SELECT *, coalesce({equal_sql("truth", "value")}, false) AS good, coalesce({equal_sql("alternative", "value")}, false) AS listed, coalesce({equal_sql("taken_back", "value")}, false) AS was,
  kind = 'number' AND try_cast(value AS DOUBLE) IS NULL AS odd FROM c5),
c7 AS (SELECT *, CASE
  WHEN truth IS NULL THEN CASE WHEN value IS NULL AND is_health THEN 'health-correct-null' WHEN value IS NULL THEN 'correct-null' WHEN listed THEN 'soft' WHEN is_health AND value = 'Not Tested' THEN 'silent-not-tested' WHEN is_health AND value = 'Passed' THEN 'health-hallucinated-pass' WHEN is_health THEN 'health-hallucinated-problem' ELSE 'hallucination' END
  WHEN value IS NULL THEN CASE WHEN acceptable_miss THEN 'excused' WHEN is_health THEN 'health-miss' ELSE 'miss' END
  WHEN odd AND NOT listed THEN 'unscorable' WHEN NOT good AND listed THEN 'sanctioned' WHEN is_health AND good THEN 'health-correct' WHEN is_health AND value = 'Passed' THEN 'health-hallucinated-pass' WHEN is_health THEN 'health-wrong-state'
  WHEN was THEN 'retracted' WHEN good THEN 'correct' ELSE 'wrong' END AS verdict FROM c6),
j AS (SELECT *, CASE WHEN verdict IN ('correct', 'sanctioned', 'health-correct') THEN 'captured' WHEN verdict IN ('correct-null', 'health-correct-null') THEN 'absent' WHEN verdict IN ('miss', 'health-miss', 'unscorable') THEN 'short' WHEN verdict IN ('excused', 'soft', 'silent-not-tested') THEN 'excused' ELSE 'fault' END AS bucket,
  CASE WHEN value IS NULL AND source_span IS NULL THEN NULL WHEN source_span IS NULL THEN 'missing' WHEN contains(text, source_span) THEN NULL ELSE 'near-miss' END AS span_issue FROM c7)"""
