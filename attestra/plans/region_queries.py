"""Regions of frames, with each user's events in the role of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import regions as R
from attestra.plans.tables import FRAMES, frames, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BINARIZED = f"""{FRAMES}, m AS (SELECT *, CASE WHEN p >= 0.5 THEN frame WHEN p < 0.35 THEN -frame - 1 END AS mark FROM f),
g AS (SELECT *, arg_max(mark, frame) FILTER (mark IS NOT NULL) OVER (PARTITION BY stream ORDER BY frame) AS held FROM m),
i AS (SELECT stream, frame, frame - row_number() OVER (PARTITION BY stream ORDER BY frame) AS island FROM g WHERE held >= 0),
b AS (SELECT stream, min(frame) AS start, max(frame) + 1 AS "end" FROM i GROUP BY stream, island)"""


def kept_sql(silence: int, speech: int) -> str:
    """Up to k: regions whose gaps are bridged, long enough."""
    return f"""{BINARIZED}, a AS (SELECT *, coalesce(CAST(start - lag("end") OVER (PARTITION BY stream ORDER BY start) >= {silence} AS INT), 1) AS apart FROM b),
s AS (SELECT *, sum(apart) OVER (PARTITION BY stream ORDER BY start) AS island FROM a), r AS (SELECT stream, min(start) AS start, max("end") AS "end" FROM s GROUP BY stream, island),
k AS (SELECT * FROM r WHERE "end" - start >= {speech})"""


def padded_sql(pad: int) -> str:
    """From k to d: regions widened."""
    return f"""n AS (SELECT stream, max(frame) + 1 AS length FROM f GROUP BY stream),
w AS (SELECT k.*, length, lag("end") OVER v AS before, lead(start) OVER v AS after FROM k JOIN n USING (stream) WINDOW v AS (PARTITION BY stream ORDER BY start)),
d AS (SELECT stream, CAST(CASE WHEN before IS NOT NULL AND least(length, before + {pad}) > greatest(0, start - {pad}) THEN (before + start) // 2 ELSE greatest(0, start - {pad}) END AS BIGINT) AS start, CAST(CASE WHEN after IS NOT NULL AND least(length, "end" + {pad}) > greatest(0, after - {pad}) THEN ("end" + after) // 2 ELSE least(length, "end" + {pad}) END AS BIGINT) AS "end" FROM w)"""


def merged_sql(regions: str, span: int) -> str:
    """From a table of regions to x: neighbours joined."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY start) AS i FROM {regions}),
t AS (SELECT stream, i, start, start AS first, "end" FROM o WHERE i = 1 UNION ALL SELECT o.stream, o.i, o.start, CASE WHEN o."end" - t.first <= {span} THEN t.first ELSE o.start END, o."end" FROM t JOIN o ON o.stream = t.stream AND o.i = t.i + 1),
x AS (SELECT stream, first AS start, max("end") AS "end" FROM t GROUP BY stream, first)"""


def cut_sql(span: int) -> str:
    """From x to y: regions parted at the quietest frame of their middle half, until none is longer."""
    return f"""h AS (SELECT stream, start, "end" FROM x UNION ALL SELECT stream, unnest([start, quiet]), unnest([quiet, "end"]) FROM (SELECT h.stream, h.start, h."end", arg_min(f.frame, (f.p, f.frame)) AS quiet FROM h JOIN f ON f.stream = h.stream AND f.frame >= h.start + (h."end" - h.start) // 4 AND f.frame < h.start + (3 * (h."end" - h.start) + 3) // 4 WHERE h."end" - h.start > {span} GROUP BY h.stream, h.start, h."end")),
y AS (SELECT * FROM h WHERE "end" - start <= {span})"""


KEPT = kept_sql(3, 2)


@query(f'WITH {BINARIZED} SELECT stream, start, "end" FROM b')
def win_binarized(spark, sf_dir):
    """WIN-01."""
    return R.binarized(frames(spark, sf_dir))


@query(f'WITH {KEPT} SELECT stream, start, "end" FROM k')
def win_bridged(spark, sf_dir):
    """WIN-02, WIN-03, SRT-10."""
    return R.long_enough(R.bridged(R.binarized(frames(spark, sf_dir)), 3), 2)


def _padded(spark, sf_dir):
    f = frames(spark, sf_dir)
    return R.padded(win_bridged(spark, sf_dir), 2, f.groupBy("stream").agg((F.max("frame") + 1).alias("length")))


@query(f'WITH {KEPT}, {padded_sql(2)} SELECT stream, start, "end" FROM d')
def win_padded(spark, sf_dir):
    """WIN-04."""
    return _padded(spark, sf_dir)


@query(f'WITH RECURSIVE {KEPT}, {merged_sql("k", 12)} SELECT stream, start, "end" FROM x')
def win_merged(spark, sf_dir):
    """WIN-05."""
    return R.merged(win_bridged(spark, sf_dir), 12)


@query(f'WITH RECURSIVE {KEPT}, {padded_sql(2)}, {merged_sql("d", 30)}, {cut_sql(6)} SELECT stream, start, "end" FROM y')
def win_cut(spark, sf_dir):
    """WIN-06: parted again and again at the quietest frame."""
    return R.cut(R.merged(_padded(spark, sf_dir), 30), frames(spark, sf_dir), 6)


@query(f'WITH RECURSIVE {kept_sql(2, 5)}, {padded_sql(4)}, {merged_sql("d", 12)}, {cut_sql(12)} SELECT stream, least(length * 800, start * 800 + 100) AS start, least(length * 800, "end" * 800 + 100) AS "end" FROM y JOIN n USING (stream)')
def win_chunks(spark, sf_dir):
    """WIN-07, MTH-09: from frames to samples, all steps."""
    f = frames(spark, sf_dir)
    samples = f.groupBy("stream").agg(((F.max("frame") + 1) * 800).alias("n"))
    return R.chunks(f, 16000, 800, 100, samples, max_chunk_ms=600)


@query("""WITH n AS (SELECT o_orderkey AS stream, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders) SELECT stream, s AS start, least(n, s + 30000) AS "end" FROM (SELECT stream, n, unnest(range(0, CASE WHEN n <= 30000 THEN 1 ELSE CAST(ceil((n - 30000) / 20000.0) AS BIGINT) * 20000 + 1 END, 20000)) AS s FROM n)""")
def win_overlapping(spark, sf_dir):
    """WIN-08, WIN-09."""
    lengths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream"), F.col("o_totalprice").cast("long").alias("n"))
    return R.overlapping_windows(lengths, 30_000, 20_000)


@query("""WITH n AS (SELECT o_orderkey AS stream, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders) SELECT stream, least(n, k * 40000) AS "end" FROM (SELECT stream, n, unnest(range(1, CAST(ceil(n / 40000.0) AS BIGINT) + 1)) AS k FROM n)""")
def win_fixed_pauses(spark, sf_dir):
    """WIN-14."""
    lengths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream"), F.col("o_totalprice").cast("long").alias("n"))
    return R.fixed_pauses(lengths, 40_000)


@query(f"WITH {FRAMES}, w AS (SELECT stream, unnest([frame, frame + 2]) AS frame, p FROM f) SELECT stream, frame, avg(p) AS p FROM w GROUP BY stream, frame")
def agg_overlap_average(spark, sf_dir):
    """AGG-27."""
    return R.averaged(frames(spark, sf_dir).select("stream", F.explode(F.array(F.col("frame"), F.col("frame") + 2)).alias("frame"), "p"))


@query(f"WITH {FRAMES} SELECT stream, round(sqrt(avg(p * p)), 9) AS rms, round(least(1.0, sqrt(avg(pow((p * 255 - 128) / 128.0, 2)))), 9) AS byte_rms FROM f GROUP BY stream")
def agg_loudness(spark, sf_dir):
    """AGG-28, AGG-29."""
    f = frames(spark, sf_dir)
    of_bytes = R.byte_loudness(f.withColumn("b", F.col("p") * 255), "b").withColumnRenamed("rms", "byte_rms")
    return R.loudness(f, "p").join(of_bytes, "stream").select("stream", F.round("rms", 9).alias("rms"), F.round("byte_rms", 9).alias("byte_rms"))
