"""Streams over the driver's tables, run to their end, and JSON in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.queue import ACTIVE, LEAST_RATE, MAX_ATTEMPTS
from attestra.plans.tables import queue, table
from attestra.sources import json_text as J
from attestra.sources import run_store as S
from attestra.sources.folders import shared_folder
from attestra.sources.lines import files_written, line_stream
from attestra.streaming import processors as P
from attestra.streaming.captures import health_in_captures, of_the_last_registered
from attestra.streaming.folds import drained, streamed
from attestra.streaming.live_view import LiveView, retractions
from attestra.streaming.timed import timed

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _ms(c: str = "ts"):
    return F.unix_millis(F.col(c).cast("timestamp"))


#: Each user's events in order, one step of a recursion each.
LOG = "e AS MATERIALIZED (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events)"


def _region_sql(kind: str, n: str, first: str, last: str, start: str) -> str:
    """A row that the live detector emits, with a pad of 1."""
    return f"{{'kind': {kind}, 'start': {start}, 'end': {start} + {n}, 'speech_start': {start} + CASE WHEN {first} < 0 THEN 0 ELSE greatest(0, {first} - 1) END, 'speech_end': {start} + CASE WHEN {first} < 0 THEN {n} ELSE least({n}, {last} + 2) END}}"


_REGIONS = f"""WITH RECURSIVE {LOG}, t AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS start, 0 AS n, 0 AS speech, 0 AS silence, false AS inside, -1 AS first, -1 AS last, [{_region_sql("''", "0", "0", "0", "min(ms)")}][2:] AS found FROM e GROUP BY user_id
UNION ALL SELECT user_id, i, CASE WHEN closes THEN -1 WHEN done THEN ms + 1 ELSE start END, CASE WHEN done THEN 0 ELSE n END, CASE WHEN done THEN 0 ELSE speech END, CASE WHEN done THEN 0 ELSE silence END, inside AND NOT done, CASE WHEN done THEN -1 ELSE first END, CASE WHEN done THEN -1 ELSE last END,
  list_concat(found, CASE WHEN done AND NOT closes OR asks OR closes AND first >= 0 THEN [{_region_sql("CASE WHEN closes THEN 'drain' WHEN done THEN 'commit' ELSE 'refresh' END", "n", "first", "last", "start")}] ELSE [] END)
FROM (SELECT *, closes OR (quiet AND silence >= 2 AND speech >= 2 AND n >= 6) AS done, NOT closes AND quiet AND silence = 1 AND speech >= 2 AS asks
FROM (SELECT user_id, i, ms, closes, start, n, found, inside OR heard AS inside, inside AND NOT heard AS quiet, speech + CAST(heard AS INT) AS speech, CASE WHEN heard THEN 0 WHEN inside THEN silence + 1 ELSE silence END AS silence, CASE WHEN heard AND NOT inside AND first < 0 THEN n - 1 ELSE first END AS first, CASE WHEN heard THEN n - 1 ELSE last END AS last
FROM (SELECT *, NOT closes AND CASE WHEN inside THEN p >= 0.1 ELSE p >= 0.3 END AS heard
FROM (SELECT user_id, i, ms, p, closes, CASE WHEN full_ OR start < 0 AND NOT closes THEN ms ELSE start END AS start, CASE WHEN closes THEN n WHEN full_ THEN 1 ELSE n + 1 END AS n, CASE WHEN full_ THEN 0 ELSE speech END AS speech, CASE WHEN full_ THEN 0 ELSE silence END AS silence, inside AND NOT full_ AS inside, CASE WHEN full_ THEN -1 ELSE first END AS first, CASE WHEN full_ THEN -1 ELSE last END AS last,
  CASE WHEN full_ THEN [{_region_sql("'commit'", "n", "first", "last", "start")}] ELSE [] END AS found
FROM (SELECT e.user_id, e.i, e.ms, e.value / 200 AS p, e.event_id % 23 = 0 AS closes, t.n >= 20 AND e.event_id % 23 <> 0 AS full_, t.start, t.n, t.speech, t.silence, t.inside, t.first, t.last FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1))))))
SELECT user_id, x.kind AS kind, x.start AS start, x."end" AS "end", x.speech_start AS speech_start, x.speech_end AS speech_end FROM (SELECT user_id, unnest(found) AS x FROM t)"""


@query(_REGIONS)
def stm_live_regions(spark, sf_dir):
    """STM-13, 14, 15, UDF-11: commits and refreshes of each user's stream, and what is left when it closes."""
    frames = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("frame"), F.when(F.col("event_id") % 23 != 0, F.col("value") / 200).alias("p"))
    return drained(streamed(frames, "user_id", ["frame", "event_id"], P.live_regions(refresh=1, commit=2, least=6, cap=20, speech=2, pad=1)), shared_folder(spark, "live_regions"))


_RELAY = f"""WITH RECURSIVE {LOG}, g AS MATERIALIZED (SELECT user_id, i, ms, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'review' ELSE 'reopen' END AS event, CASE WHEN event_type <> 'purchase' THEN props WHEN event_id % 5 = 0 THEN 'discarded' ELSE 'accepted' END AS text, event_id % 11 = 0 AS terminal FROM e),
t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ms, false AS acts, CAST(NULL AS VARCHAR) AS status, false AS heard, false AS extracted, CAST(NULL AS VARCHAR) AS outcome, 0 AS attempts, CAST(0 AS BIGINT) AS due FROM g
UNION ALL SELECT user_id, i, ms, acts, CASE WHEN NOT acts THEN status WHEN event = 'enqueue' THEN 'queued' WHEN event = 'failed' THEN CASE WHEN final THEN 'dead' ELSE 'failed' END WHEN event = 'review' THEN CASE WHEN text = 'discarded' THEN 'discarded' ELSE 'writing' END WHEN event = 'reopen' THEN 'awaiting-review'
    WHEN doing = 'transcribe' AND length(trim(text)) >= {LEAST_RATE} THEN 'extracting' WHEN doing <> 'write' THEN 'awaiting-review' WHEN lost THEN 'dead' ELSE 'done' END,
  heard OR (acts AND event = 'ok'), extracted OR (acts AND event = 'ok' AND doing = 'extract'), CASE WHEN acts AND event = 'review' THEN text WHEN acts AND event = 'reopen' THEN NULL ELSE outcome END,
  CASE WHEN acts AND event = 'failed' THEN attempts + 1 WHEN acts AND (event = 'review' OR event = 'ok' AND NOT (doing = 'write' AND lost)) THEN 0 ELSE attempts END,
  CASE WHEN acts AND event = 'failed' THEN CASE WHEN final THEN 0 ELSE ms + CAST(least(60000, 1000 * pow(2, attempts)) AS BIGINT) END WHEN acts AND event = 'ok' AND NOT (doing = 'write' AND lost) THEN 0 ELSE due END
FROM (SELECT g.*, t.status, t.heard, t.extracted, t.outcome, t.attempts, t.due, coalesce(t.outcome, 'discarded') = 'discarded' AS lost, g.terminal OR t.attempts + 1 >= {MAX_ATTEMPTS} AS final, CASE WHEN NOT t.heard THEN 'transcribe' WHEN NOT t.extracted THEN 'extract' ELSE 'write' END AS doing,
  coalesce(CASE g.event WHEN 'enqueue' THEN t.status IS NULL WHEN 'review' THEN t.status = 'awaiting-review' WHEN 'reopen' THEN t.status = 'dead' AND t.heard AND t.extracted ELSE t.status IN {tuple(sorted(ACTIVE))} AND g.ms >= t.due END, false) AS acts FROM t JOIN g ON g.user_id = t.user_id AND g.i = t.i + 1))
SELECT user_id, ms AS at_ms, status, attempts, nullif(due, 0) AS due_ms FROM t WHERE acts"""


@query(_RELAY)
def stm_relay(spark, sf_dir):
    """STM-02, 03, 04, 05, 06, 08, 09, 12, 26: items' states, event by event."""
    kinds = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "purchase", "review").otherwise("reopen")
    text = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 5 == 0, "discarded").otherwise("accepted")).otherwise(F.col("props"))
    log = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("at_ms"), kinds.alias("event"), text.alias("text"), (F.col("event_id") % 11 == 0).alias("terminal"), F.lit(1000).alias("duration_ms"))
    return drained(streamed(log, "user_id", ["at_ms", "event_id"], P.relay()), shared_folder(spark, "relay"))


_SESSION = f"""WITH RECURSIVE {LOG}, g AS MATERIALIZED (SELECT user_id, i, ms AS start, CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN ms ELSE ms + 1 + CAST(floor(value) AS BIGINT) END AS "end", CASE event_type WHEN 'signup' THEN 'opened' WHEN 'purchase' THEN 'commit' WHEN 'click' THEN 'refresh' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'close' ELSE 'failed' END ELSE 'done' END AS event FROM e),
t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, false AS open, false AS leaves, false AS refresh, false AS commits, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS upto, [{{'kind': '', 'start': start, 'end': start}}][2:] AS jobs, [{{'kind': '', 'start': start, 'end': start}}][2:] AS told FROM g WHERE i = 1
UNION ALL SELECT user_id, i, CASE WHEN NOT open THEN event = 'opened' AND NOT leaves ELSE NOT ends END, NOT open AND event <> 'opened' AND (leaves OR event = 'close'),
  open AND NOT ends AND CASE WHEN event = 'refresh' THEN true WHEN pops AND kind = 'tail' THEN false ELSE refresh END, open AND NOT ends AND CASE WHEN event = 'commit' THEN true WHEN pops AND kind = 'commit' AND NOT again THEN false ELSE commits END,
  CASE WHEN NOT open OR ends OR again OR joins THEN NULL WHEN event = 'commit' AND commits THEN coalesce(since, start) ELSE since END, CASE WHEN NOT open OR ends OR again OR joins THEN NULL WHEN event = 'commit' AND commits THEN "end" ELSE upto END,
  CASE WHEN NOT open OR ends THEN [] WHEN joins THEN list_prepend({{'kind': 'commit', 'start': next[1].start, 'end': upto}}, next[2:]) ELSE next END,
  list_concat(CASE WHEN pops THEN [{{'kind': CASE WHEN event = 'failed' THEN 'error' WHEN kind = 'tail' THEN 'tail' ELSE 'commit' END, 'start': jobs[1].start, 'end': jobs[1]."end"}}] WHEN NOT open AND event = 'opened' THEN [{{'kind': 'opened', 'start': CAST(NULL AS BIGINT), 'end': CAST(NULL AS BIGINT)}}] ELSE [] END,
    CASE WHEN ends OR (NOT open AND event = 'opened' AND leaves) THEN [{{'kind': 'closed', 'start': CAST(NULL AS BIGINT), 'end': CAST(NULL AS BIGINT)}}] ELSE [] END)
FROM (SELECT *, pops AND NOT again AND since IS NOT NULL AND len(next) > 0 AND coalesce(next[1].kind = 'commit', false) AS joins
FROM (SELECT *, CASE WHEN event = 'refresh' AND NOT refresh THEN list_append(jobs, {{'kind': 'tail', 'start': start, 'end': "end"}}) WHEN event = 'commit' AND NOT commits THEN list_append(jobs, {{'kind': 'commit', 'start': start, 'end': "end"}}) WHEN event = 'close' THEN list_append(jobs, {{'kind': 'close', 'start': start, 'end': "end"}})
    WHEN again THEN list_append(jobs[2:], {{'kind': 'commit', 'start': since, 'end': upto}}) WHEN pops THEN jobs[2:] ELSE jobs END AS next
FROM (SELECT *, pops AND kind = 'commit' AND since IS NOT NULL AS again, open AND (event = 'close' AND "end" <= start OR pops AND kind = 'close') AS ends
FROM (SELECT g.*, t.open, t.leaves, t.refresh, t.commits, t.since, t.upto, t.jobs, coalesce(t.jobs[1].kind, '') AS kind, t.open AND g.event IN ('done', 'failed') AND len(t.jobs) > 0 AS pops FROM t JOIN g ON g.user_id = t.user_id AND g.i = t.i + 1)))))
SELECT user_id, x.kind AS kind, x.start AS start, x."end" AS "end" FROM (SELECT user_id, unnest(told) AS x FROM t)"""


@query(_SESSION)
def stm_live_session(spark, sf_dir):
    """STM-16, 17, 28, UDF-24: what live sessions send, their transcriptions one after the other."""
    kind = F.when(F.col("event_type") == "signup", "opened").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "click", "refresh").when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "close").otherwise("failed")).otherwise("done")
    length = F.when((F.col("event_type") == "error") & (F.col("event_id") % 6 == 0), 0).otherwise(F.floor("value") + 1)
    log = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("start"), (_ms() + length).alias("end"), kind.alias("event"))
    return drained(streamed(log, "user_id", ["start", "event_id"], P.live_session()), shared_folder(spark, "live_session"))


_CAPTURE = f"""WITH RECURSIVE {LOG}, g AS MATERIALIZED (SELECT user_id, i, ms, CAST(floor(value) AS BIGINT) AS n, CASE WHEN event_type = 'purchase' THEN 'resumed' WHEN event_type = 'view' THEN 'tick' WHEN event_id % 97 = 0 THEN 'close' ELSE 'blob' END AS event FROM e),
t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS n, '' AS event, CAST(-1 AS BIGINT) AS last, false AS resumed, false AS stalled, false AS closed, CAST(0 AS BIGINT) AS chunk, false AS latches, false AS stores FROM g
UNION ALL SELECT user_id, i, ms, n, event, CASE WHEN event = 'tick' AND last >= 0 THEN last ELSE ms END, event = 'resumed' OR (resumed AND event <> 'blob'), stalled OR latches, closed OR event = 'close', CASE WHEN event = 'blob' AND NOT closed THEN chunk + 1 ELSE chunk END, latches, event = 'blob' AND NOT closed
FROM (SELECT g.*, t.last, t.resumed, t.stalled, t.closed, t.chunk, NOT t.closed AND NOT t.stalled AND t.last >= 0 AND g.ms - t.last > 43200000 AND (g.event = 'tick' OR g.event = 'blob' AND NOT t.resumed) AS latches FROM t JOIN g ON g.user_id = t.user_id AND g.i = t.i + 1))
SELECT user_id, ms AS at_ms, CAST(NULL AS BIGINT) AS chunk, CAST(NULL AS BIGINT) AS slice, CAST(NULL AS BIGINT) AS n_bytes, 'stalled' AS health FROM t WHERE latches
UNION ALL SELECT user_id, ms, chunk - 1, k, least(100, n - 100 * k), CASE WHEN stalled THEN 'stalled' ELSE 'flushing' END FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(n / 100.0) AS BIGINT)))) AS k FROM t WHERE stores)"""


@query(_CAPTURE)
def stm_capture(spark, sf_dir):
    """STM-19: recordings' chunks as they are stored, and whether they stall."""
    kind = F.when(F.col("event_type") == "purchase", "resumed").when(F.col("event_type") == "view", "tick").when(F.col("event_id") % 97 == 0, "close").otherwise("blob")
    log = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("at_ms"), kind.alias("event"), F.floor("value").alias("n_bytes"))
    return drained(streamed(log, "user_id", ["at_ms", "event_id"], P.capture(12 * 3600 * 1000, 100)), shared_folder(spark, "capture"))


_PREVIEWS = f"""WITH RECURSIVE {LOG}, t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, false AS taken, CAST(0 AS BIGINT) AS session, false AS done, CAST([] AS VARCHAR[]) AS committed, CAST(NULL AS VARCHAR) AS tail FROM e
UNION ALL SELECT user_id, i, takes, CASE WHEN takes THEN now ELSE session END, done OR (takes AND event = 'handoff'), CASE WHEN takes AND event = 'handoff' THEN [] WHEN takes AND event = 'commit' THEN list_append(committed, props) ELSE committed END, CASE WHEN NOT takes THEN tail WHEN event = 'tail' THEN props END
FROM (SELECT e.user_id, e.i, e.props, t.session, t.done, t.committed, t.tail, CAST(floor(e.value / 400) AS BIGINT) AS now, NOT t.done AND floor(e.value / 400) >= t.session AS takes, CASE WHEN e.event_type = 'purchase' THEN 'commit' WHEN e.event_type = 'error' AND e.event_id % 9 = 0 THEN 'handoff' ELSE 'tail' END AS event FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1))
SELECT user_id, len(committed) AS n_committed, array_to_string(committed, ' ') AS text, tail, done FROM t WHERE taken"""


@query(_PREVIEWS)
def stm_previews(spark, sf_dir):
    """STM-10, 11, 12, 27, UDF-06: what live previews show, all of an item's committed text with each change; items that have been handed off are forgotten after a day."""
    kind = F.when(F.col("event_type") == "purchase", "commit").when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "handoff").otherwise("tail")
    log = events(spark, sf_dir).select("user_id", "event_id", F.timestamp_millis(_ms()).alias("time"), _ms().alias("at"), kind.alias("event"), F.col("props").alias("text"), F.floor(F.col("value") / 400).alias("session"))
    return drained(timed(log, "user_id", ["at", "event_id"], P.previews(whole=True), "time", "at", 24 * 3600 * 1000), shared_folder(spark, "previews"))


_CONNECTIVITY = f"""WITH RECURSIVE {LOG}, t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'offline' AS status, CAST(0 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS healthy, CAST(NULL AS BIGINT) AS first_at, 'none' AS first, CAST(NULL AS BIGINT) AS second_at, 'none' AS second FROM e
UNION ALL SELECT user_id, i, CASE WHEN falls THEN 'offline' WHEN starts THEN 'probing' ELSE now END, CASE WHEN starts THEN ms ELSE since END, CASE WHEN starts THEN -1 WHEN event_type = 'click' AND now = 'probing' AND healthy < 0 THEN ms ELSE healthy END, CASE WHEN now <> status THEN first_at END, CASE WHEN now <> status THEN now ELSE 'none' END, CASE WHEN falls OR starts THEN ms END, CASE WHEN falls THEN 'offline' WHEN starts THEN 'probing' ELSE 'none' END
FROM (SELECT *, now <> 'offline' AND (event_type = 'error' OR event_type NOT IN ('error', 'view', 'click') AND now = 'probing') AS falls, event_type = 'view' AND now = 'offline' AS starts
FROM (SELECT e.user_id, e.i, e.ms, e.event_type, t.status, t.since, t.healthy, CASE WHEN t.status = 'probing' AND t.healthy >= 0 AND e.ms >= t.healthy + 3000 THEN 'online' WHEN t.status = 'probing' AND t.healthy < 0 AND e.ms >= t.since + 5000 THEN 'offline' ELSE t.status END AS now, CASE WHEN t.healthy >= 0 THEN t.healthy + 3000 ELSE t.since + 5000 END AS first_at FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1)))
SELECT user_id, x.at_ms AS at_ms, x.status AS status FROM (SELECT user_id, unnest([{{'at_ms': first_at, 'status': first}}, {{'at_ms': second_at, 'status': second}}]) AS x FROM t) WHERE x.status <> 'none'
UNION ALL SELECT user_id, at_ms, status FROM (SELECT user_id, CASE WHEN healthy >= 0 THEN healthy + 3000 ELSE since + 5000 END AS at_ms, CASE WHEN healthy >= 0 THEN 'online' ELSE 'offline' END AS status FROM t QUALIFY i = max(i) OVER (PARTITION BY user_id) AND status = 'probing') WHERE at_ms <= (SELECT max(ms) FROM e)"""


@query(_CONNECTIVITY)
def stm_connectivity(spark, sf_dir):
    """STM-22: devices' statuses; a probe's deadline and the time of stability are timers, which fire without a further event once the stream's time has passed them."""
    kind = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "view", "up").when(F.col("event_type") == "click", "probe_ok").otherwise("probe_failed")
    log = events(spark, sf_dir).select("user_id", "event_id", F.timestamp_millis(_ms()).alias("time"), _ms().alias("at_ms"), kind.alias("event"))
    return drained(timed(log, "user_id", ["at_ms", "event_id"], P.connectivity(), "time", "at_ms", 24 * 3600 * 1000), shared_folder(spark, "connectivity"))


@query("""WITH h AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 3 = 0 THEN event_type END AS word FROM events), l AS (SELECT *, row_number() OVER v AS i, lag(word) OVER v AS before FROM h WINDOW v AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN word = before THEN 4 ELSE 3 END AS same FROM l), c AS (SELECT *, coalesce(max(same) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS committed FROM s)
SELECT user_id, CASE WHEN committed > 0 THEN word WHEN same = 4 THEN 'the same words ' || word ELSE 'the same words' END AS words, CAST(same AS BIGINT) AS n_committed FROM c WHERE same > committed""")
def stm_agreement(spark, sf_dir):
    """STM-31, WIN-13, STR-25."""
    log = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("at"), F.concat_ws(" ", F.lit("the same words"), F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("text"))
    return drained(streamed(log, "user_id", ["at", "event_id"], P.agreement()), shared_folder(spark, "agreement"))


@query("WITH l AS (SELECT user_id, arg_max({'k': event_type, 'v': value}, (epoch_us(ts) // 1000, event_id)) AS l FROM events GROUP BY user_id) SELECT l.k AS event_type, count(*) AS n, round(sum(l.v), 4) AS total FROM l WHERE l.k <> 'error' GROUP BY l.k")
def stm_live_summary(spark, sf_dir):
    """SRC-06, STM-32: users by what they did last, kept up by changes: each event takes back what its user counted for before; an error takes the user out."""
    log = events(spark, sf_dir).select("user_id", "event_id", _ms().alias("at"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"))
    changes = streamed(log, "user_id", ["at", "event_id"], retractions({"event_type": "string", "value": "double"}))
    folder = shared_folder(spark, "summary")
    view = LiveView(spark, f"{folder}/view", ["event_type"], ["value"])
    view.start(changes, f"{folder}/state").awaitTermination()
    return view.read().select("event_type", "n", F.round("value", 4).alias("total"))


@query("""WITH c AS (SELECT user_id, event_id AS capture, ts AS b, ts + INTERVAL 1 MINUTE * CAST(floor(value) AS BIGINT) AS e FROM events WHERE event_type = 'view'), h AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type <> 'view')
SELECT h.user_id, h.event_id, arg_max(c.capture, (c.b, c.capture)) AS capture, any_value(h.event_type) AS health FROM h JOIN c ON h.user_id = c.user_id AND h.ts >= c.b AND h.ts < c.e GROUP BY h.user_id, h.event_id""")
def stm_capture_health(spark, sf_dir):
    """STM-33: what was said of health while a device's capture was active, two streams joined by intervals; the capture that was registered last counts."""
    at = F.col("ts").cast("timestamp")
    captures = events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("device"), F.col("event_id").alias("capture"), at.alias("begin"), F.timestamp_add("MINUTE", F.floor("value").cast("int"), at).alias("end"))
    health = events(spark, sf_dir).where("event_type != 'view'").select(F.col("user_id").alias("device"), "event_id", at.alias("at"), F.col("event_type").alias("health"))
    joined = drained(health_in_captures(captures, health), shared_folder(spark, "captures"))
    return of_the_last_registered(joined, ["device", "event_id"]).select(F.col("device").alias("user_id"), "event_id", "capture", "health")


@query("""WITH q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS k FROM events), s AS (SELECT user_id, unnest([event_id, -event_id, event_id // 2]) AS sample, unnest([3 * k, 3 * k + 1, 3 * k + 2]) AS k FROM q),
f AS (SELECT user_id, k // 4 AS frame, list(CAST(sample AS DOUBLE) ORDER BY k) AS samples FROM s GROUP BY ALL) SELECT user_id, frame, samples FROM f WHERE len(samples) = 4""")
def stm_reframed(spark, sf_dir):
    """STM-18: quanta of three samples as frames of four, in a stream: what does not fill a frame is held until more comes."""
    i = F.col("event_id")
    log = events(spark, sf_dir).select("user_id", "event_id", F.timestamp_millis(_ms()).alias("time"), _ms().alias("at"), F.array(i, -i, F.floor(i / 2)).cast("array<double>").alias("samples"))
    return drained(timed(log, "user_id", ["at", "event_id"], P.reframed(4), "time", "at", 24 * 3600 * 1000, "10 minutes"), shared_folder(spark, "reframed"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def src_json_repair(spark, sf_dir):
    """SRC-21."""
    k, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(k == 0, props).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone {not}."))).when(k == 2, F.concat(F.lit("So: "), props, F.lit(" as asked"))).otherwise(F.concat(F.lit("no "), F.regexp_replace(props, "[}]", "")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(J.repaired(raw), "k bigint")["k"].alias("k"))


@query("""SELECT event_id, '{"n": "}' || event_id || '{", "p": ' || props || '}' AS found FROM events""")
def src_last_object(spark, sf_dir):
    """SRC-22, SRC-23."""
    last = F.concat(F.lit('{"n": "}'), F.col("event_id"), F.lit('{", "p": '), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", J.last_object(F.concat(F.lit('first {"a": 1} then } '), last, F.lit(' and " {"'))).alias("found"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view' AND event_id % 10 <> 3")
def src_marked_lines(spark, sf_dir):
    """SRC-33: a stream of log lines; those with a marker and JSON that can be read are taken, all others skipped."""
    folder, props = shared_folder(spark, "log"), F.col("props")
    measure = F.regexp_replace(props, "^[{]", F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(", ")))
    line = F.when(F.col("event_type") != "view", F.concat(F.lit("12:00 other "), measure)).when(F.col("event_id") % 10 == 3, F.concat(F.lit("12:00 @@MEASURE@@ {garbled "), measure)).otherwise(F.concat(F.lit("12:00 @@MEASURE@@ "), measure))
    table(spark, sf_dir, "events").select(line).write.text(f"{folder}/in")
    log = line_stream(spark, f"{folder}/in", "*.txt")
    return drained(J.marked_lines(log.select("text"), "@@MEASURE@@ ", "event_id long, k long"), folder)


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 10 < 8 THEN l_quantity END AS quantity, l_partkey % 10 >= 8 AS malformed FROM lineitem WHERE l_partkey % 10 <> 7")
def src_json_lines(spark, sf_dir):
    """SRC-24: JSON lines from ranges of bytes; blank lines are skipped, malformed ones told with their places."""
    folder, k = shared_folder(spark, "jsonl"), F.col("l_partkey") % 10
    record = F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity")))
    torn = F.concat(F.substring_index(record, ",", 2), F.lit(" torn"))
    table(spark, sf_dir, "lineitem").select(F.when(k == 7, F.lit("  ")).when(k >= 8, torn).otherwise(record)).write.text(folder)
    kept = J.json_lines(spark, folder, "id long, n long, quantity double", "keep", "*.txt", 1 << 20)
    part = lambda name: F.regexp_extract("malformed", f'"{name}":([0-9]+)', 1).cast("long")
    return kept.select(F.coalesce("id", part("id")).alias("id"), F.coalesce("n", part("n")).alias("n"), "quantity", F.col("problem").isNotNull().alias("malformed"))


@query("""SELECT 'supplier ' || s_suppkey AS slug, CASE s_suppkey % 5 WHEN 0 THEN 'old format' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no transcript' END AS problem, CASE WHEN s_suppkey % 5 <> 2 THEN s_name END AS text FROM supplier WHERE s_suppkey % 7 <> 0""")
def src_truth_files(spark, sf_dir):
    """SRC-19: a folder of `*.json` with what is true joined to the `*.txt` of the same names; what can't be graded is told, what is contaminated left out."""
    folder, k = shared_folder(spark, "truth"), F.col("s_suppkey") % 5
    name = F.concat(F.lit("supplier "), F.col("s_suppkey")).alias("name")
    rows = table(spark, sf_dir, "supplier")
    files_written(rows.select(name, F.when(k == 0, '{"fields": {}}').when(k == 1, '{"leaves": ').otherwise('{"leaves": {}}').alias("text")), f"{folder}/truth", ".json")
    files_written(rows.where(k != 2).select(name, F.col("s_name").alias("text")), f"{folder}/texts", ".txt")
    return J.truth_files(spark, f"{folder}/truth", f"{folder}/texts", rows.where("s_suppkey % 7 = 0").select(name.alias("slug"))).select("slug", "problem", "text")


@query("""WITH a AS (SELECT o_custkey AS key, max(o_orderdate) AS seen_at, 'a' AS which FROM orders GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_orderdate) AS seen_at, 'b' AS which FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'F' GROUP BY 1), u AS (SELECT * FROM a WHERE key % 2 = 0 UNION ALL SELECT * FROM b)
SELECT key, max(seen_at) AS seen_at, arg_max(which, (seen_at, CASE which WHEN 'a' THEN 1 ELSE 0 END)) AS which FROM u GROUP BY key""")
def src_newest_replica(spark, sf_dir):
    """SRC-45."""
    o = table(spark, sf_dir, "orders")
    of = lambda rows, which: rows.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("seen_at")).withColumn("which", F.lit(which))
    return S.newest(of(o.where("o_custkey % 2 = 0"), "a"), of(o.where("o_orderkey % 3 = 0 OR o_orderstatus = 'F'"), "b"))


@query("""SELECT s.s_suppkey % 40 AS key, 'x' AS verdict FROM supplier s WHERE false UNION ALL SELECT key, CASE WHEN was IS NULL THEN 'first-visit' WHEN was > 0 AND coalesce(now, 0) = 0 THEN 'evicted' ELSE 'intact' END FROM (SELECT s_suppkey AS key, s_suppkey % 3 AS was FROM supplier) m FULL JOIN (SELECT o_custkey % 20 AS key, count(*) AS now FROM orders GROUP BY 1) n USING (key)""")
def prj_eviction(spark, sf_dir):
    """PRJ-32, STM-32."""
    markers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 3).alias("n"))
    return S.eviction(markers, queue(spark, sf_dir))


@query("SELECT p_partkey AS doc, unnest([CAST(0 AS BIGINT), 1]) AS ord, unnest(['a', 'b']) AS name, unnest([p_name, p_brand]) AS description FROM part")
def src_described(spark, sf_dir):
    """SRC-46."""
    text = F.concat(F.lit('{"properties": {"a": {"description": "'), F.col("p_name"), F.lit('", "items": {"properties": {"a": {"description": "no"}, "b": {"description": "'), F.col("p_brand"), F.lit('"}}}}}}'))
    return J.described(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")))


@query("""SELECT p_partkey AS doc, '{"properties":{"description":{"type":"string"},"n":{"items":{"properties":{"b":{"type":"' || lower(replace(p_brand, '#', '')) || '"}}},"type":"array"}}}' AS text FROM part""")
def prj_undescribed(spark, sf_dir):
    """PRJ-19."""
    kind = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    text = F.concat(F.lit('{"description": "'), F.col("p_name"), F.lit('", "properties": {"n": {"type": "array", "description": "d", "items": {"properties": {"b": {"description": "e", "type": "'), kind, F.lit('"}}}}, "description": {"type": "string", "description": "f"}}}'))
    return J.undescribed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")))


@query("""SELECT p_partkey AS doc, '{"properties":{"a":{"description":"outer ' || p_size || '","type":"string"},"anyOf":{"type":"number"},"b":{"description":"inner","items":{"type":"integer"},"type":"array"},"c":{"anyOf":[{"type":"string"},{"type":"number"},{"type":"null"}]}},"type":"object"}' AS text FROM part""")
def prj_unwrapped(spark, sf_dir):
    """PRJ-21: schemas whose values may be null as what they are otherwise; the outer description stays."""
    outer = F.concat(F.lit('"description": "outer '), F.col("p_size"), F.lit('"'))
    text = F.concat(
        F.lit('{"type": "object", "properties": {"a": {"anyOf": [{"oneOf": [{"type": "null"}, {"type": "string", "description": "inner"}], "description": "between"}, {"type": "null"}], '), outer,
        F.lit('}, "anyOf": {"type": ["null", "number"]}, "b": {"anyOf": [{"type": "array", "items": {"type": ["integer", "null"]}, "description": "inner"}, {"type": "null"}]}, "c": {"anyOf": [{"type": "string"}, {"type": "number"}, {"type": "null"}]}}}'),
    )
    return J.unwrapped(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("text")))
