"""The queue's writes, recovery and drain, with orders in the role of its items."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators import queue as Q
from attestra.operators import writes as W
from attestra.plans.queue_queries import _ACTIVE, _CHUNKS, _chunks
from attestra.plans.tables import QUEUE, queue, table
from attestra.sources.folders import shared_folder, written
from attestra.sources.outbox import Outbox
from attestra.sources.versions import VersionConflict
from attestra.sources.write_sink import Adapter, WriteSink, folder_writer, tool_rows

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit("2003-01-01").cast("timestamp_ntz")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").cast("binary").alias("audio"), F.col("c_nationkey").cast("string").alias("source_id"))


@query(f"""WITH {QUEUE}, top AS (SELECT max(seq) AS top FROM q) SELECT 'c' || c_custkey AS id, top + row_number() OVER (ORDER BY c_custkey) AS seq, 'queued' AS status, CAST(0 AS INT) AS attempts, TIMESTAMP '2003-01-01' AS next_attempt_at, 'key-' || c_custkey AS idempotency_key, md5(c_name) AS audio FROM customer, top""")
def src_enqueued(spark, sf_dir):
    """SRC-07: new items with their audio in the same rows, numbered on, with keys of their own."""
    new = W.enqueued(queue(spark, sf_dir), _customers(spark, sf_dir), "c_custkey", _now(), F.concat(F.lit("key-"), F.col("c_custkey")))
    return new.select("id", "seq", "status", "attempts", "next_attempt_at", "idempotency_key", F.md5("audio").alias("audio"))


@query(f"""WITH {QUEUE}, top AS (SELECT max(seq) AS top FROM q) SELECT 'c' || c_custkey AS id, top + row_number() OVER (ORDER BY c_custkey) AS seq, 'recording' AS status, CAST(c_nationkey AS VARCHAR) AS source_id, true AS keyed FROM customer, top""")
def src_begun(spark, sf_dir):
    """SRC-08: new items that are being recorded, each with its source; keys are uuids, one for each."""
    new = W.begun(queue(spark, sf_dir), _customers(spark, sf_dir).drop("audio"), "c_custkey", _now())
    return new.select("id", "seq", "status", "source_id", (F.length("idempotency_key") == 36).alias("keyed"))


@query(f"""WITH {QUEUE}, {_CHUNKS}, n AS (SELECT id, 'audio-' || id || '-999999' AS name, 'new' AS bytes FROM q WHERE seq % 3 = 0 UNION ALL SELECT CAST(c_custkey * 1000000007 AS VARCHAR), 'audio-0', 'lost' FROM customer),
a AS (SELECT * FROM c UNION ALL SELECT n.* FROM n SEMI JOIN q USING (id)) SELECT id, count(*) AS n, max(name) AS last, md5(string_agg(bytes, '' ORDER BY name, bytes)) AS whole FROM a GROUP BY id""")
def src_appended_chunks(spark, sf_dir):
    """SRC-09: chunks appended to items that are there; those of unknown items are told apart."""
    items = queue(spark, sf_dir)
    known = items.where("seq % 3 = 0").select("id", F.concat(F.lit("audio-"), F.col("id"), F.lit("-999999")).alias("name"), F.lit("new").cast("binary").alias("bytes"))
    lost = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 1_000_000_007).cast("string").alias("id"), F.lit("audio-0").alias("name"), F.lit("lost").cast("binary").alias("bytes"))
    all_, _ = W.with_chunk(items, _chunks(spark, sf_dir), known.unionByName(lost))
    sorted_ = F.array_sort(F.collect_list(F.struct("name", "bytes")))
    return all_.groupBy("id").agg(F.count("*").alias("n"), F.max("name").alias("last"), F.md5(F.aggregate(sorted_, F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))).alias("whole"))


_COMMITS = "k AS (SELECT id, seq * 10 AS ms, 'new' || id AS said FROM q WHERE seq % 4 < 3 UNION ALL SELECT 'none' || c_custkey, 1, 'lost' FROM customer WHERE c_custkey % 50 = 0), m AS (SELECT id, q.status, q.duration_ms, q.id IS NOT NULL AS there, k.ms, k.said, k.id IS NOT NULL AS asked FROM q FULL JOIN k USING (id))"


def _committed(spark, sf_dir):
    """Commits of three in four items, and of some that aren't there."""
    items = queue(spark, sf_dir)
    audio = items.where("seq % 10 < 5").select("id", F.concat(F.lit("old"), F.col("id")).cast("binary").alias("bytes"))
    known = items.where("seq % 4 < 3").select("id", (F.col("seq") * 10).alias("duration_ms"), F.concat(F.lit("new"), F.col("id")).cast("binary").alias("audio"))
    lost = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("none"), F.col("c_custkey")).alias("id"), F.lit(1).cast("long").alias("duration_ms"), F.lit("lost").cast("binary").alias("audio"))
    return W.committed(items, _chunks(spark, sf_dir), audio, known.unionByName(lost))


@query(f"""WITH {QUEUE}, {_COMMITS} SELECT id, CASE WHEN asked AND status = 'recording' THEN 'queued' ELSE status END AS status, CASE WHEN asked AND status = 'recording' THEN ms ELSE duration_ms END AS duration_ms, CASE WHEN NOT there THEN 'no item' WHEN asked AND status <> 'recording' THEN status || ', not recording' END AS problem FROM m""")
def src_committed(spark, sf_dir):
    """SRC-12: only an item that is being recorded is committed; others are refused and stay, unknown ones are told."""
    return _committed(spark, sf_dir)[0].select("id", "status", "duration_ms", "problem")


@query(f"""WITH {QUEUE}, {_COMMITS}, {_CHUNKS} SELECT id, count(*) AS n FROM c ANTI JOIN (SELECT id FROM m WHERE asked AND status = 'recording') USING (id) GROUP BY id""")
def src_chunks_after_commit(spark, sf_dir):
    """SRC-12: a commit sweeps its item's chunks, and no others."""
    return _committed(spark, sf_dir)[1].groupBy("id").agg(F.count("*").alias("n"))


@query(f"""WITH {QUEUE}, {_COMMITS}, w AS (SELECT id, said FROM m WHERE asked AND status = 'recording') SELECT id, coalesce(w.said, 'old' || id) AS audio FROM (SELECT id FROM q WHERE seq % 10 < 5) o FULL JOIN w USING (id)""")
def src_audio_after_commit(spark, sf_dir):
    """SRC-12: a commit stores its audio in place of what was there; one that is refused stores none."""
    return _committed(spark, sf_dir)[2].select("id", F.col("bytes").cast("string").alias("audio"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN length(c_name) END AS n_bytes, CASE WHEN c_custkey % 3 > 0 THEN md5(c_name) END AS audio FROM customer")
def src_audio(spark, sf_dir):
    """SRC-13: audio bytes by id; an id without audio has none."""
    there = _customers(spark, sf_dir)
    return W.audio_of(there.where("c_custkey % 3 > 0").withColumnRenamed("audio", "bytes"), there).select("id", F.length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("audio"))


@query(f"""WITH {QUEUE}, {_CHUNKS}, p AS (SELECT id, sum(length(bytes)) AS parts FROM c GROUP BY id) SELECT q.id, q.seq % 3 <> 1 AS audio_ready, CAST(CASE WHEN q.seq % 3 <> 1 THEN 5 WHEN status = 'recording' THEN coalesce(parts, 0) ELSE 0 END AS BIGINT) AS audio_bytes FROM q LEFT JOIN p USING (id)""")
def src_audio_dropped(spark, sf_dir):
    """SRC-14: after its audio is dropped an item stays and is no longer audio_ready."""
    items = queue(spark, sf_dir)
    audio = items.select("id", F.lit("audio").cast("binary").alias("bytes"))
    return Q.with_audio(items, W.without_audio(audio, items.where("seq % 3 = 1")), _chunks(spark, sf_dir)).select("id", "audio_ready", "audio_bytes")


@query(f"""WITH {QUEUE}, g AS (SELECT id FROM q WHERE status IN ('done', 'discarded')) SELECT (SELECT count(*) FROM g) AS n_gone, count(*) AS n_left, min(seq) AS first, max(seq) AS last FROM q ANTI JOIN g USING (id)""")
def src_cleared(spark, sf_dir):
    """SRC-15, SRC-16, SRC-17: everything that a listing selects is deleted, and counted."""
    left, gone = W.cleared(queue(spark, sf_dir), ["done", "discarded"])
    return left.agg(F.count("*").alias("n_left"), F.min("seq").alias("first"), F.max("seq").alias("last")).join(gone.agg(F.count("*").alias("n_gone")))


_WRITES = """w AS (SELECT l_orderkey AS id, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS version, CASE WHEN l_linenumber % 3 <> 1 THEN l_returnflag END AS status, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS n, CASE WHEN l_linenumber = 5 THEN 'status' WHEN l_linenumber = 3 THEN 'n' END AS unset, l_linenumber IN (3, 7) AND l_linestatus = 'F' AS deleted FROM lineitem)"""


@query(f"""WITH {_WRITES}, d AS (SELECT id, max(version) FILTER (deleted) AS gone, max(version) AS last FROM w GROUP BY id), s AS (SELECT w.* FROM w JOIN d USING (id) WHERE gone IS NULL OR version > gone),
f AS (SELECT id, max_by(CASE WHEN unset = 'status' AND status IS NULL THEN '-' ELSE status END, version) FILTER (status IS NOT NULL OR unset = 'status') AS status, max_by(CASE WHEN unset = 'n' AND n IS NULL THEN -1 ELSE n END, version) FILTER (n IS NOT NULL OR unset = 'n') AS n FROM s GROUP BY id)
SELECT id, nullif(status, '-') AS status, nullif(n, -1) AS n FROM f""")
def src_folded(spark, sf_dir):
    """SRC-01, SRC-15, SRC-18: of each field the last value that a write set or unset since the last deletion; some items are written again after it."""
    line = F.col("l_linenumber")
    log = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("version"), F.when(line % 3 != 1, F.col("l_returnflag")).alias("status"), F.when(line % 2 == 0, F.col("l_quantity")).alias("n"),
        F.when(line == 5, F.array(F.lit("status"))).when(line == 3, F.array(F.lit("n"))).alias("unset"), (line.isin(3, 7) & (F.col("l_linestatus") == "F")).alias("deleted"),
    )
    return W.folded(log, ["status", "n"])


@query(f"""WITH {QUEUE}, p AS (SELECT id, seq % 6 AS k, seq FROM q WHERE seq % 6 < 4 UNION ALL SELECT 'none' || c_custkey, 0, 0 FROM customer WHERE c_custkey % 100 = 0)
SELECT id, CASE WHEN q.id IS NULL THEN NULL WHEN p.k = 0 THEN 'done' ELSE q.status END AS status, CASE WHEN p.k = 3 THEN q.attempts + 1 ELSE q.attempts END AS attempts, CASE WHEN p.k = 3 THEN NULL ELSE q.transcript END AS transcript, CASE WHEN q.id IS NULL THEN 'no item' WHEN p.k = 1 THEN 'unknown status' WHEN p.k = 2 THEN 'bad attempts' END AS problem FROM q FULL JOIN p USING (id)""")
def src_patched(spark, sf_dir):
    """SRC-18: a patch changes the fields that it names, and only if the whole row is then still right."""
    items, k = queue(spark, sf_dir), F.col("seq") % 6
    none = F.lit(None).cast("string")
    patches = items.where("seq % 6 < 4").select("id", F.when(k == 0, "done").when(k == 1, "odd").alias("status"), F.when(k == 2, -1).when(k == 3, F.col("attempts") + 1).alias("attempts"), none.alias("transcript"), F.when(k == 3, F.array(F.lit("transcript"))).alias("unset"))
    missing = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("none"), F.col("c_custkey")).alias("id"), F.lit("done").alias("status"), F.lit(None).cast("int").alias("attempts"), none.alias("transcript"), F.lit(None).cast("array<string>").alias("unset"))
    return W.patched(items, patches.unionByName(missing), ["status", "attempts", "transcript"]).select("id", "status", "attempts", "transcript", "problem")


_RECOVERY = f"""{{queue}}, {_CHUNKS}, r AS (SELECT id, seq, CASE WHEN seq % 20 <> 10 THEN 's' END AS source FROM q WHERE status = 'recording'),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name DESC) AS back, count(*) OVER (PARTITION BY id) AS n FROM c),
d AS (SELECT id, md5(string_agg(bytes, '' ORDER BY name)) AS whole, sum(length(bytes)) AS wms, md5(string_agg(bytes, '' ORDER BY name) FILTER (back > 1)) AS most, sum(length(bytes)) FILTER (back > 1) AS mms, right(string_agg(bytes, '' ORDER BY name), 1) AS wend, right(string_agg(bytes, '' ORDER BY name) FILTER (back > 1), 1) AS mend FROM o GROUP BY id),
t AS (SELECT r.*, CASE WHEN wend < '4' THEN wms END AS whole_ms, CASE WHEN mend < '4' THEN mms END AS most_ms, whole, most FROM r LEFT JOIN d USING (id))"""


def _recovered(spark, sf_dir):
    # bytes can be read if the last chunk they end with is one of the first three lines
    items = queue(spark, sf_dir).withColumn("source_id", F.when(F.col("seq") % 20 != 10, "s"))
    decode = lambda b: F.when(F.right(b.cast("string"), F.lit(1)) < "4", F.length(b).cast("long"))
    return W.recovered(items, _chunks(spark, sf_dir), decode, "seq", _now(), lambda i: F.concat(F.lit("new-"), i), F.concat(F.lit("key-"), F.col("id")))


@query("WITH " + _RECOVERY.replace("{queue}", QUEUE) + """ SELECT id, 'dead' AS status, CASE WHEN source IS NULL THEN 'unrecoverable: no capture.sourceId' WHEN coalesce(whole_ms, most_ms) IS NULL THEN 'unrecoverable: cannot decode audio' ELSE 'recovered as new-' || id END AS last_error FROM t""")
def stm_recovered(spark, sf_dir):
    """STM-20, STM-21: what becomes of recordings that a crash cut short."""
    return _recovered(spark, sf_dir)[0]


@query("WITH " + _RECOVERY.replace("{queue}", QUEUE) + """ SELECT 'new-' || id AS id, (SELECT max(seq) FROM q) + row_number() OVER (ORDER BY t.seq) AS seq, 'queued' AS status, CAST(coalesce(whole_ms, most_ms) AS BIGINT) AS duration_ms, CASE WHEN whole_ms IS NOT NULL THEN whole ELSE most END AS audio,
q.device, 'key-new-' || id AS idempotency_key, CAST(0 AS INT) AS attempts, TIMESTAMP '2003-01-01' AS next_attempt_at, TIMESTAMP '2003-01-01' AS enqueued_at FROM t JOIN q USING (id) WHERE source IS NOT NULL AND coalesce(whole_ms, most_ms) IS NOT NULL""")
def stm_recovered_items(spark, sf_dir):
    """STM-20, STM-21: the new items that take their places, whole ones like any other: the recording's own columns, a key, no attempts, times."""
    return _recovered(spark, sf_dir)[1].withColumn("audio", F.md5("audio"))


@query(f"""WITH {QUEUE}, b AS (SELECT device FROM q WHERE status = 'recording' AND device % 3 <> 0), a AS (SELECT *, CASE WHEN seq % 7 = 1 THEN 'transient' WHEN seq % 7 = 3 THEN 'terminal' ELSE 'ok' END AS outcome, next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2003-01-01' AS due FROM q WHERE status IN {_ACTIVE}),
s AS (SELECT *, coalesce(max(CASE WHEN NOT due OR outcome = 'transient' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM a ANTI JOIN b USING (device)) SELECT device, id, seq, outcome FROM s WHERE stopped = 0 AND due""")
def stm_drain_steps(spark, sf_dir):
    """STM-01: one step after the other from the lowest active seq, until one isn't due or fails for now; a queue that is recorded to waits."""
    k = F.col("seq") % 7
    items = queue(spark, sf_dir).where("status != 'recording' OR device % 3 != 0").withColumn("outcome", F.when(k == 1, "transient").when(k == 3, "terminal").otherwise("ok"))
    return W.drained(items, _now(), "outcome", "device").select("device", "id", "seq", "outcome")


@query(f"""WITH {QUEUE}, x AS (SELECT id, attempts + 1 AS attempts FROM q WHERE status IN ('transcribing', 'extracting', 'writing') AND seq % 1800 > 900) SELECT id, CASE WHEN attempts >= 8 THEN 'dead' ELSE 'failed' END AS status, attempts FROM x""")
def stm_timed_out(spark, sf_dir):
    """STM-07: a step that runs for over a quarter of an hour fails like any other."""
    started = F.timestamp_add("SECOND", -(F.col("seq") % 1800).cast("int"), _now())
    running = queue(spark, sf_dir).where(F.col("status").isin("transcribing", "extracting", "writing")).where(W.timed_out(started, _now()))
    return Q.after_failure(running, F.lit(True), _now(), F.lit(1000)).select("id", "status", "attempts")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS bare, o_orderkey % 4 AS k FROM orders) SELECT id, CASE WHEN bare THEN 'context lacks job' WHEN k = 0 THEN 'nothing to write' WHEN k = 1 THEN 'unknown fields odd' END AS problem FROM x""")
def prj_write_problems(spark, sf_dir):
    """UDF-04, UDF-05: a write step checks context and values before it writes."""
    k = F.col("o_orderkey") % 4
    values = F.when(k == 1, F.create_map(F.lit("odd"), F.lit("1"))).when(k > 1, F.create_map(F.lit("price"), F.lit("1")))
    context = F.create_map(F.lit("job"), F.when(F.col("o_orderkey") % 5 != 0, "j"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), W.write_problem(values, ["price", "state"], context, ["job"]).alias("problem"))


_TOOL = """x AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, 'k' || o_orderkey // 3 AS idempotency_key, o_totalprice AS price, 'house ' || o_custkey AS job, CASE WHEN o_orderkey % 5 = 0 THEN 'context lacks job' WHEN o_orderkey % 7 = 1 THEN 'unknown fields odd' WHEN o_orderkey % 7 = 2 THEN 'wrong fields price' WHEN o_orderkey % 7 = 3 THEN 'nothing to write' END AS problem FROM orders)"""


def _tool_writes(spark, sf_dir):
    """orders as a stream into a tool that takes files. The first run breaks off between the write and the ledger; the second goes on from its checkpoint; a third, from the beginning, finds all written."""
    k = F.col("o_orderkey") % 7
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    price, fields = F.col("o_totalprice").alias("price"), F.to_json(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state")))
    fields = F.when(k == 1, F.to_json(F.struct(price, F.lit(1).alias("odd")))).when(k == 2, '{"price": "much"}').when(k == 3, "{}").otherwise(fields)
    context = F.when(F.col("o_orderkey") % 5 == 0, "{}").otherwise(F.to_json(F.struct(F.concat(F.lit("house "), F.col("o_custkey")).alias("job"))))
    items = orders.select(F.col("o_orderkey").alias("id"), fields.alias("fields"), context.alias("context"), F.concat(F.lit("k"), F.floor(F.col("o_orderkey") / 3)).alias("idempotency_key"))
    values, where = T.StructType().add("price", "double").add("state", "string"), T.StructType().add("job", "string")
    root, left = shared_folder(spark, "tool"), [True]

    def breaks(batch: str) -> None:
        if left.pop():
            raise RuntimeError(f"{batch} breaks off before its entry in the ledger")

    adapter = Adapter("orders", values, where, folder_writer(f"{root}/rows"))
    broken, sink = WriteSink(spark, f"{root}/sink", adapter, breaks), WriteSink(spark, f"{root}/sink", adapter)
    try:
        broken.start(items, f"{root}/checkpoint").awaitTermination()
    except StreamingQueryException:
        sink.start(items, f"{root}/checkpoint").awaitTermination()
    sink.start(items, f"{root}/checkpoint2").awaitTermination()
    schema = T.StructType().add("id", "long").add("fields", values).add("context", where).add("idempotency_key", "string")
    return sink, tool_rows(sink, f"{root}/rows", schema)


@query(f"WITH {_TOOL} SELECT idempotency_key, min(id) AS id, arg_min(price, id) AS price, arg_min(job, id) AS job FROM x WHERE problem IS NULL GROUP BY idempotency_key")
def src_tool_writes(spark, sf_dir):
    """SRC-43, UDF-04, UDF-05: reviewed values are written into a tool through a ledger, each key once though the stream breaks off in between and is run again."""
    return _tool_writes(spark, sf_dir)[1].select("idempotency_key", "id", "fields.price", "context.job")


@query(f"WITH {_TOOL} SELECT CAST(id AS VARCHAR) AS id, problem FROM x WHERE problem IS NOT NULL")
def src_refused_writes(spark, sf_dir):
    """SRC-43, UDF-05: what can never be written is told, and why."""
    return _tool_writes(spark, sf_dir)[0].refused().select("id", "problem").distinct()


_RUNS = "r AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS label, date_trunc('year', o_orderdate) AS captured_at, count(*) AS n FROM orders GROUP BY ALL)"


def _run_store(spark, sf_dir):
    """Runs of five labels by year: of 0 all but the last three entries are pruned, of 1 the entry of 1997 is deleted, 2 is deleted as a whole."""
    import datetime

    from attestra.sources.folders import shared_folder
    from attestra.sources.run_store import RunStore

    runs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).cast("string").alias("label"), F.date_trunc("year", "o_orderdate").alias("captured_at")).agg(F.count("*").alias("n"))
    store = RunStore(spark, shared_folder(spark, "runs"))
    store.save(runs)
    store.prune("0", 3)
    store.delete_entry("1", datetime.datetime(1997, 1, 1))
    store.delete_run("2")
    return store


@query(f"""WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY captured_at DESC) AS k FROM r) SELECT label, captured_at, n FROM k WHERE label <> '2' AND (label <> '0' OR k <= 3) AND (label <> '1' OR captured_at <> TIMESTAMP '1997-01-01')""")
def src_run_history(spark, sf_dir):
    """SRC-25, SRC-28, SRC-29, SRC-30: histories after pruning and deletions, each a version of its own."""
    return _run_store(spark, sf_dir).history().select(F.col("label").cast("string").alias("label"), "captured_at", "n")


@query(f"WITH {_RUNS} SELECT label, captured_at, n FROM r WHERE label <> '2'")
def src_run_current(spark, sf_dir):
    """SRC-26, SRC-27: what was saved last of every label that is there."""
    store = _run_store(spark, sf_dir)
    return store.current().join(store.labels(), "label").select(F.col("label").cast("string").alias("label"), "captured_at", "n")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'queued' END AS status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 2 END AS INT) AS attempts FROM orders")
def src_migrated_log(spark, sf_dir):
    """SRC-02, SRC-03, SRC-18: a log whose first rows have fewer columns is read like one of today; an append that was made from an older version than the last is refused and made again; the log is dropped once it has been read."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), k.alias("seq"))
    box = Outbox(spark, shared_folder(spark, "outbox"))
    rows.select("id", F.lit(1).cast("long").alias("version"), "seq", F.lit("queued").alias("status")).write.parquet(box.path)
    seen = box.version()
    box.append(rows.where("seq % 3 = 0").withColumn("version", F.lit(2)).withColumn("status", F.lit("done")).withColumn("attempts", F.lit(1)), seen)
    late = lambda v: rows.where("seq % 3 = 1").withColumn("version", F.lit(v)).withColumn("status", F.lit("failed")).withColumn("attempts", F.lit(v))
    try:
        box.append(late(9), seen)
    except VersionConflict:
        box.append(late(2), box.version())
    items = written(box.items().select("id", "seq", "status", "attempts"))
    box.drop()
    return items
