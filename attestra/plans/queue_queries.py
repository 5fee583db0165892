"""The queue's operators, with orders in the role of its items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.operators import engines as E
from attestra.operators import queue as Q
from attestra.plans.tables import QUEUE, queue, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ACTIVE = "('queued', 'transcribing', 'extracting', 'writing', 'failed')"


@query(f"WITH {QUEUE} SELECT id, seq, status, attempts FROM q WHERE status IN ('failed', 'queued') ORDER BY seq LIMIT 500")
def src_listed(spark, sf_dir):
    """SRC-04, PRJ-01, SRT-01."""
    return Q.listed(queue(spark, sf_dir), ["failed", "queued"], 500).select("id", "seq", "status", "attempts")


@query(f"WITH {QUEUE} SELECT id, seq, status, transcript FROM q WHERE id = '77'")
def src_point_lookup(spark, sf_dir):
    """SRC-05."""
    return queue(spark, sf_dir).where("id = '77'").select("id", "seq", "status", "transcript")


@query(f"""WITH {QUEUE} SELECT id, status IN {_ACTIVE} AS active, CASE WHEN transcript IS NULL THEN 'transcribe' WHEN extracted IS NULL THEN 'extract' ELSE 'write' END AS step,
  coalesce(duration_ms > 0 AND length(trim(transcript)) * 1000 / duration_ms < 0.5, false) AS implausible,
  NOT (seq % 17 = 3) AND NOT (seq % 7 < 4 AND 400 + seq % 40 < 500 AND 400 + seq % 40 NOT IN (408, 429)) AS transient, seq % 5 IN (1, 2) AS permanent FROM q""")
def prj_item_predicates(spark, sf_dir):
    """PRJ-04, 07, 08, 09, 10."""
    k = F.col("seq")
    http = F.when(k % 7 < 4, 400 + k % 40)
    reason = F.element_at(F.array(*map(F.lit, ("not-downloaded", "unsupported-platform", "too-slow", "busy", "offline"))), (k % 5).cast("int") + 1)
    return queue(spark, sf_dir).select("id", Q.is_active(F.col("status")).alias("active"), Q.next_step(F.col("transcript"), F.col("extracted")).alias("step"), Q.implausible(F.col("transcript"), F.col("duration_ms")).alias("implausible"), Q.transient(http, k % 17 == 3).alias("transient"), Q.permanently_unavailable(reason).alias("permanent"))


@query(f"WITH {QUEUE} SELECT id, seq, status, attempts FROM q WHERE seq = (SELECT min(seq) FROM q WHERE status IN {_ACTIVE})")
def prj_head(spark, sf_dir):
    """PRJ-05."""
    return Q.head(queue(spark, sf_dir)).select("id", "seq", "status", "attempts")


@query(f"""WITH {QUEUE}, r AS (SELECT * FROM q WHERE status <> 'recording'), h AS (SELECT * FROM r WHERE seq = (SELECT min(seq) FROM r WHERE status IN {_ACTIVE}))
SELECT id, seq, status FROM h WHERE next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2002-01-01'""")
def prj_due_head(spark, sf_dir):
    """PRJ-06, DAT-02."""
    return Q.due(queue(spark, sf_dir).where("status != 'recording'"), F.lit("2002-01-01").cast("timestamp_ntz")).select("id", "seq", "status")


@query(f"""WITH {QUEUE}, w AS (SELECT device, count(*) FILTER (status IN {_ACTIVE} OR status IN ('recording', 'awaiting-review')) AS pending, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'done') AS synced, count(*) FILTER (status = 'awaiting-review') AS awaiting_review FROM q WHERE status <> 'dead' OR device % 4 = 0 GROUP BY device)
SELECT *, CASE WHEN dead > 0 THEN 'action-required' WHEN device % 5 = 1 THEN 'at-risk' WHEN pending = 0 THEN 'safe' WHEN device % 5 = 2 THEN 'protected' WHEN device % 3 <> 0 THEN 'at-risk' ELSE 'protected' END AS level,
  CASE WHEN dead > 0 THEN 'failed-permanently' WHEN device % 5 = 1 THEN 'capture-stalled' WHEN pending = 0 AND synced > 0 THEN 'all-synced' WHEN pending = 0 THEN 'nothing-captured' WHEN device % 5 = 2 THEN 'recording' WHEN device % 3 <> 0 THEN 'not-persisted' ELSE 'awaiting-sync' END AS reason FROM w""")
def agg_work_safety(spark, sf_dir):
    """AGG-01, PRJ-31, UDF-18."""
    items = queue(spark, sf_dir).where("status != 'dead' OR device % 4 = 0")
    work = Q.summary(items, ["device"])
    d = F.col("device")
    return Q.safety(work, F.when(d % 3 == 0, "granted").otherwise("prompt"), F.when(d % 5 == 1, "stalled").when(d % 5 == 2, "flushing"))


@query(f"WITH {QUEUE} SELECT coalesce(max(seq), -1) AS highest, coalesce(max(CASE WHEN seq < 0 THEN seq END), -1) AS of_none FROM q")
def agg_highest_seq(spark, sf_dir):
    """AGG-03."""
    return queue(spark, sf_dir).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("highest"), F.coalesce(F.max(F.when(F.col("seq") < 0, F.col("seq"))), F.lit(-1)).alias("of_none"))


@query(f"""WITH {QUEUE}, top AS (SELECT max(seq) AS top FROM q), n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) SELECT id, top + r AS seq FROM n, top""")
def src_new_seq(spark, sf_dir):
    """AGG-03: numbers for a batch of new items, from the highest onwards."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Q.with_seq(queue(spark, sf_dir), new, "id")


def _chunks(spark, sf_dir):
    """lineitem as chunks of the orders' recordings."""
    n = F.col("l_linenumber").cast("string")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("audio-"), F.col("l_orderkey"), F.lit("-00000"), n, F.lit("-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit("-"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit("-"), F.format_string("%010.2f", "l_extendedprice")).alias("name"), F.concat(F.col("l_returnflag"), F.col("l_linestatus"), n).cast("binary").alias("bytes"))


_CHUNKS = "c AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, 'audio-' || l_orderkey || '-00000' || l_linenumber || '-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '-' || printf('%010.2f', l_extendedprice) AS name, l_returnflag || l_linestatus || l_linenumber AS bytes FROM lineitem)"


@query(f"WITH {_CHUNKS} SELECT id, md5(string_agg(bytes, '' ORDER BY name)) AS whole, CAST(sum(length(bytes)) AS BIGINT) AS n FROM c GROUP BY id")
def src_merged_chunks(spark, sf_dir):
    """SRC-10, SRT-02, AGG-02."""
    merged = Q.merged_chunks(_chunks(spark, sf_dir))
    return merged.select("id", F.md5("bytes").alias("whole"), F.length("bytes").cast("long").alias("n"))


@query(f"WITH {_CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name DESC, bytes DESC) AS r FROM c) SELECT id, md5(string_agg(bytes, '' ORDER BY name) FILTER (r > 1)) AS whole FROM r GROUP BY id")
def src_merged_without_last(spark, sf_dir):
    """SRC-11: what is left for a second attempt at recovery."""
    return Q.merged_chunks(_chunks(spark, sf_dir), without_last=True).select("id", F.md5("bytes").alias("whole"))


@query(f"""WITH {QUEUE}, {_CHUNKS}, p AS (SELECT id, sum(length(bytes)) AS parts FROM c GROUP BY id), a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, length(c_name) AS whole FROM customer)
SELECT q.id, whole IS NOT NULL AS audio_ready, CAST(CASE WHEN whole IS NOT NULL THEN whole WHEN status = 'recording' THEN coalesce(parts, 0) ELSE 0 END AS BIGINT) AS audio_bytes FROM q LEFT JOIN p USING (id) LEFT JOIN a USING (id)""")
def prj_with_audio(spark, sf_dir):
    """PRJ-02."""
    audio = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").cast("binary").alias("bytes"))
    return Q.with_audio(queue(spark, sf_dir), audio, _chunks(spark, sf_dir)).select("id", "audio_ready", "audio_bytes")


_LOG = "l AS (SELECT l_orderkey AS id, l_partkey * 10000000 + l_suppkey * 100 + l_linenumber AS version, l_returnflag AS status, l_quantity AS n, l_linestatus = 'F' AND l_linenumber = 7 AS deleted FROM lineitem)"


@query(f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM l) SELECT id, status, n FROM r WHERE r = 1 AND NOT deleted")
def src_latest_of_log(spark, sf_dir):
    """SRC-01, SRC-35: the current rows of an append-only log."""
    version = F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), version.alias("version"), F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("n"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("deleted"))
    return Q.latest(log)


@query(f"""WITH {QUEUE}, x AS (SELECT *, seq % 13 <> 5 AS again, attempts + 1 AS n FROM q WHERE status IN ('transcribing', 'extracting', 'writing'))
SELECT id, CASE WHEN NOT again OR n >= 8 THEN 'dead' ELSE 'failed' END AS status, n AS attempts, CASE WHEN again AND n < 8 THEN TIMESTAMP '2003-01-01' + INTERVAL (CAST(floor(least(60000.0, 1000 * pow(2, attempts)) * 0.5) AS INT)) MILLISECOND END AS next_attempt_at FROM x""")
def stm_after_failure(spark, sf_dir):
    """STM-06, MTH-04, DAT-03."""
    from attestra.functions.numbers import jitter_delay

    failing = queue(spark, sf_dir).where(F.col("status").isin("transcribing", "extracting", "writing"))
    after = Q.after_failure(failing, F.col("seq") % 13 != 5, F.lit("2003-01-01").cast("timestamp_ntz"), jitter_delay(F.col("attempts"), 1000, 60000, F.lit(0.5)))
    return after.select("id", "status", "attempts", "next_attempt_at")


@query(f"""WITH {QUEUE}, x AS (SELECT *, [408, 422, 500, 503, 404][CAST(seq % 5 AS INT) + 1] AS code, seq % 13 = 5 AS final, attempts + 1 AS n FROM q WHERE status IN ('transcribing', 'extracting', 'writing')), y AS (SELECT *, NOT final AND (code >= 500 OR code = 404) AS again FROM x)
SELECT id, CASE WHEN NOT again OR n >= 5 THEN 'dead' ELSE 'failed' END AS status, n AS attempts, CASE WHEN again AND n < 5 THEN TIMESTAMP '2003-01-01' + INTERVAL (CAST(floor(least(9000.0, 500 * pow(2, attempts)) * 0.25) AS INT)) MILLISECOND END AS next_attempt_at FROM y""")
def stm_own_policy(spark, sf_dir):
    """UDF-12: failures under a host's own policy: 404 is tried again, 408 is not, five attempts, another clock, jitter and window."""
    policy = Q.Policy(lambda code, final: ~final & ((code >= 500) | (code == 404)), 5, lambda: F.lit("2003-01-01").cast("timestamp_ntz"), lambda: F.lit(0.25), 500, 9000)
    failing = queue(spark, sf_dir).where(F.col("status").isin("transcribing", "extracting", "writing"))
    code = F.element_at(F.array(*map(F.lit, (408, 422, 500, 503, 404))), (F.col("seq") % 5).cast("int") + 1)
    return policy.failed(failing.withColumn("code", code).withColumn("final", F.col("seq") % 13 == 5), "code", "final").select("id", "status", "attempts", "next_attempt_at")


@query(f"""WITH {QUEUE}, o AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' WHEN 2 THEN 'discarded' END AS outcome FROM q),
b AS (SELECT *, outcome IS NOT NULL AND status = 'awaiting-review' AS done FROM o)
SELECT id, CASE WHEN done AND outcome = 'discarded' THEN 'discarded' WHEN done THEN 'writing' WHEN status = 'dead' AND transcript IS NOT NULL AND extracted IS NOT NULL THEN 'awaiting-review' ELSE status END AS status, CASE WHEN done THEN 0 ELSE attempts END AS attempts FROM b""")
def stm_review_and_reopen(spark, sf_dir):
    """STM-08, STM-09: guarded changes of state."""
    items, k = queue(spark, sf_dir), F.col("seq")
    outcomes = items.where(k % 4 != 3).select("id", F.when(k % 4 == 0, "accepted").when(k % 4 == 1, "edited").otherwise("discarded").alias("outcome"))
    return Q.reopened(Q.reviewed(items, outcomes)).select("id", "status", "attempts")


@query("""WITH x AS (SELECT user_id, event_id, ts, event_type = 'error' AS down, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, event_id FROM x WHERE down AND NOT was""")
def stm_rising_edges(spark, sf_dir):
    """STM-23."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("down", F.col("event_type") == "error")
    return Q.edges(events, "user_id", "at", "down").select("user_id", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, n FROM r WHERE n <= 20""")
def stm_newest_of_each(spark, sf_dir):
    """STM-35, SRC-29, SRT-08: the last rows of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 20").select("user_id", "event_id", F.col("n").cast("long").alias("n"))


_CAPS = """a AS (SELECT l_orderkey AS request, 'engine' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS engine, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS ord, CASE l_returnflag WHEN 'A' THEN 'ready' WHEN 'N' THEN 'needs-download' ELSE 'unavailable' END AS status,
  CASE l_linestatus WHEN 'F' THEN 'too-slow' ELSE 'busy' END AS reason FROM lineitem)"""


def _capabilities(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "ready").when(F.col("l_returnflag") == "N", "needs-download").otherwise("unavailable")
    engine = F.concat(F.lit("engine"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey"))
    order = F.col("l_linenumber") * F.lit(100_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), engine.alias("engine"), order.alias("ord"), status.alias("status"), F.when(F.col("l_linestatus") == "F", "too-slow").otherwise("busy").alias("reason"))


@query(f"""WITH {_CAPS}, f AS (SELECT request, min(ord) FILTER (status = 'ready') AS first FROM a GROUP BY request)
SELECT request, min_by(engine, ord) FILTER (status = 'ready') AS engine, coalesce(list(engine ORDER BY ord) FILTER (status <> 'ready' AND (first IS NULL OR ord < first)), []) AS skipped, bool_and(status = 'unavailable' AND reason = 'too-slow') AS never FROM a JOIN f USING (request) GROUP BY request""")
def srt_first_ready(spark, sf_dir):
    """SRT-05, SRT-06, AGG-35."""
    return E.first_ready(_capabilities(spark, sf_dir))


@query(f"""WITH {_CAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY CASE status WHEN 'ready' THEN 0 WHEN 'needs-download' THEN 1 ELSE 2 END, ord) AS r FROM a) SELECT request, engine, status FROM r WHERE r = 1""")
def srt_best_capability(spark, sf_dir):
    """SRT-07."""
    return E.best_capability(_capabilities(spark, sf_dir))


@query("""WITH a AS (SELECT o_orderkey AS request, o_orderkey % 6 <> 1 AS primary_ready, o_totalprice / 10 AS primary_ms, o_orderkey % 4 <> 2 AS primary_ok, o_orderkey % 8 = 2 AS gone, o_custkey * 10.0 AS hedge_ms, o_orderkey % 5 <> 3 AS hedge_ok, CASE WHEN o_orderkey % 3 = 0 THEN 12000.0 ELSE least(30000.0, greatest(2000.0, o_custkey * 20.0 * 1.5)) END AS delay FROM orders),
b AS (SELECT *, primary_ms <= delay AS early FROM a), c AS (SELECT *, primary_ready AND early AND (primary_ok OR NOT gone) AS alone, CASE WHEN NOT primary_ready THEN 0 WHEN early AND gone THEN primary_ms ELSE delay END + hedge_ms AS hedge_end FROM b),
d AS (SELECT *, CASE WHEN alone THEN CASE WHEN primary_ok THEN 'primary' END WHEN primary_ready AND primary_ok AND (NOT hedge_ok OR primary_ms <= hedge_end) THEN 'primary' WHEN hedge_ok THEN 'hedge' END AS winner FROM c)
SELECT request, NOT alone AS hedged, winner, CASE winner WHEN 'primary' THEN primary_ms WHEN 'hedge' THEN hedge_end END AS took_ms, CASE WHEN winner IS NULL THEN CASE WHEN primary_ready THEN 'primary-failed' ELSE 'hedge-failed' END END AS error FROM d""")
def stm_hedged_race(spark, sf_dir):
    """STM-24, MTH-05, UDF-13."""
    k = F.col("o_orderkey")
    attempts = table(spark, sf_dir, "orders").select(k.alias("request"), (k % 6 != 1).alias("primary_ready"), (F.col("o_totalprice") / 10).alias("primary_ms"), (k % 4 != 2).alias("primary_ok"), (k % 8 == 2).alias("primary_unavailable"), (F.col("o_custkey") * 10.0).alias("hedge_ms"), (k % 5 != 3).alias("hedge_ok"), F.when(k % 3 != 0, F.col("o_custkey") * 20.0).alias("predicted"))
    return E.raced(attempts, F.col("predicted"), 12000).select("request", "hedged", "winner", "took_ms", "error")


@query("""WITH e AS (SELECT user_id AS engine, (epoch_us(ts) // 1000) * 100000 + event_id AS at, event_type, event_id FROM events), a AS (SELECT * FROM e WHERE event_type IN ('view', 'click')), l AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT l.engine, l.at AS at_ms, CASE WHEN a.event_type = 'click' AND a.event_id % 50 = 0 OR l.at - a.at < 8640000000000 THEN CASE a.event_type WHEN 'view' THEN 'ready' ELSE 'unavailable' END END AS status FROM l ASOF LEFT JOIN a ON l.engine = a.engine AND l.at >= a.at""")
def stm_cached_capability(spark, sf_dir):
    """STM-25: the last answer before a question, while it holds."""
    at = F.unix_millis(F.col("ts").cast("timestamp")) * 100_000 + F.col("event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("engine"), at.alias("at_ms"), "event_type", "event_id")
    answers = events.where(F.col("event_type").isin("view", "click")).select("engine", "at_ms", F.when(F.col("event_type") == "view", "ready").otherwise("unavailable").alias("status"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 50 == 0), "unsupported-platform").otherwise("busy").alias("reason"))
    return E.cached(events.where("event_type = 'purchase'"), answers, 100_000 * 86_400_000)
