import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import json_text as J
from attestra.sources.folders import shared_folder
from attestra.sources.outbox import Outbox, written_once
from attestra.sources.run_store import RunStore
from attestra.streaming import processors as P
from attestra.streaming.folds import drained, replayed, streamed


def test_outbox_log(spark):
    box = Outbox(spark, shared_folder(spark, "outbox"))
    new = lambda *rows: spark.createDataFrame(rows, "id string, version long, seq long, status string")
    box.append(new(("a", 1, 0, "queued"), ("b", 1, 1, "queued")))
    box.append(new(("a", 2, 0, "transcribing")))
    assert sorted((r.id, r.status) for r in box.items().collect()) == [("a", "transcribing"), ("b", "queued")]
    assert box.remove(spark.createDataFrame([("b",), ("none",)], "id string"), 9) == 1
    assert [r.id for r in box.items().collect()] == ["a"]
    for bad in (("c", 1, -1, "queued"), ("c", 1, 3, "lost"), ("c", 1, 3, "recording")):
        with pytest.raises(Exception, match="seq|status|source"):
            box.append(new(bad))


def test_run_store(spark):
    spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    store = RunStore(spark, shared_folder(spark, "runs"))
    for k in range(4):
        store.save(spark.createDataFrame([("x", k, k * 10)], "label string, captured_at long, n long"))
    store.save(spark.createDataFrame([("y", 0, 7)], "label string, captured_at long, n long"))
    assert [r.n for r in store.current("x").collect()] == [30] and store.labels().count() == 2
    store.delete_entry("x", 1)
    store.prune("x", 2)
    assert sorted(r.captured_at for r in store.history("x").collect()) == [2, 3] and store.history("y").count() == 1
    store.prune("x", 0)
    assert store.history("x").count() == 0
    store.delete_run("y")
    assert [r.label for r in store.labels().collect()] == ["x"]


def test_json_in_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    assert sorted((r.slug, r.text) for r in J.named_texts(spark, f"file://{tmp_path}/*.txt").collect())[0] == ("a", "one\ntwo")
    results = spark.createDataFrame([("a", '{"x": 1}'), ("b", " "), ("c", "{"), ("d", "[1]")], "slug string, text string")
    slugs = spark.createDataFrame([(x,) for x in "abcde"], "slug string")
    assert {r.slug: r.problem for r in J.loaded(results, slugs).collect()} == {"a": None, "b": "empty", "c": "malformed", "d": "no object", "e": "absent"}
    (tmp_path / "h.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n')
    assert sorted(r.n for r in J.json_lines(spark, f"file://{tmp_path}/h.jsonl", "n int").collect()) == [1, 2]
    (tmp_path / "i.jsonl").write_text('{"n": 1}\nbroken\n')
    with pytest.raises(Exception, match="line 2"):
        J.json_lines(spark, f"file://{tmp_path}/i.jsonl", "n int").collect()


def test_written_once(spark):
    writes = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "idempotency_key string, n int")
    done = spark.createDataFrame([("k2",)], "idempotency_key string")
    assert [r.idempotency_key for r in written_once(writes, done).collect()] == ["k1"]


def fold(spark, processor, rows, columns):
    kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
    schema = ", ".join(f"{c} {next((kinds[type(r[k])] for r in rows if r[k] is not None), 'string')}" for k, c in enumerate(columns))
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r)[1:] for r in replayed(frame, "key", ["at"], processor).collect()]


def test_live_regions(spark):
    p = [0.0, 0.5, 0.2, 0.5, 0.0, 0.0, 0.0, 0.9, 0.9] + [0.05] * 3 + [0.9] * 12
    got = fold(spark, P.live_regions(refresh=1, commit=3, least=5, cap=10, speech=2, pad=1), [(1, k, k, x) for k, x in enumerate(p)], ["key", "at", "frame", "p"])
    assert got == [("refresh", 0, 5, 0, 5), ("commit", 0, 7, 0, 5), ("refresh", 7, 10, 7, 10), ("commit", 7, 12, 7, 10), ("commit", 12, 22, 12, 22)]


def test_a_close_drains_what_has_speech(spark):
    p = [0.0, 0.5, 0.2, None, 0.0, None, 0.9, None]
    got = fold(spark, P.live_regions(refresh=2, commit=3, least=5, cap=10, speech=2, pad=1), [(1, k, k, x) for k, x in enumerate(p)], ["key", "at", "frame", "p"])
    assert got == [("drain", 0, 3, 0, 3), ("drain", 6, 7, 6, 7)]


def session(events):
    p = P.live_session()
    state = {**p.start, "jobs": []}
    return [(x["kind"], x["start"], x["end"]) for e, a, b in events for x in p.step(state, {"event": e, "start": a, "end": b})]


def test_live_sessions():
    asked = [("opened", 0, 0), ("refresh", 0, 5), ("refresh", 0, 7), ("commit", 0, 9), ("commit", 9, 12), ("commit", 12, 15), ("done", 0, 0), ("done", 0, 0), ("commit", 15, 20), ("failed", 0, 0), ("close", 20, 22), ("done", 0, 0), ("refresh", 22, 23), ("opened", 0, 0)]
    assert session(asked) == [("opened", None, None), ("tail", 0, 5), ("commit", 0, 15), ("error", 15, 20), ("commit", 20, 22), ("closed", None, None), ("opened", None, None)]
    again = [("opened", 0, 0), ("commit", 0, 9), ("commit", 9, 12), ("done", 0, 0), ("commit", 12, 14), ("done", 0, 0), ("done", 0, 0), ("done", 0, 0)]
    assert session(again) == [("opened", None, None), ("commit", 0, 9), ("commit", 9, 12), ("commit", 12, 14)]
    assert session([("close", 0, 4), ("commit", 0, 4), ("opened", 0, 0), ("done", 0, 0)]) == [("opened", None, None), ("closed", None, None)]
    assert session([("opened", 0, 0), ("commit", 0, 4), ("close", 5, 5), ("done", 0, 0)]) == [("opened", None, None), ("closed", None, None)]


def test_no_commit_of_a_session_is_lost():
    rnd = random.Random(5)
    for _ in range(200):
        kinds = [rnd.choice(["refresh", "commit", "done", "failed"]) for _ in range(40)]
        events, at = [("opened", 0, 0)], 0
        for k in kinds:
            events.append((k, at, at + (k == "commit")))
            at += k == "commit"
        got = session([*events, *[("done", at, at)] * 50])
        spans = [(a, b) for k, a, b in got if k in ("commit", "error") and b > a]
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)] and (not at or spans[-1][1] == at)


def test_capture(spark):
    rows = [("r", k, t, e, n) for k, (t, e, n) in enumerate([(0, "begin", 0), (10, "blob", 25), (50, "tick", 0), (200, "resumed", 0), (290, "blob", 0), (391, "tick", 0), (392, "blob", 10), (400, "close", 0), (401, "blob", 5)])]
    got = fold(spark, P.capture(100, 10), rows, ["key", "at", "at_ms", "event", "n_bytes"])
    assert got == [(10, 0, 0, 10, "flushing"), (10, 0, 1, 10, "flushing"), (10, 0, 2, 5, "flushing"), (290, 1, 0, 0, "flushing"), (391, None, None, None, "stalled"), (392, 2, 0, 10, "stalled")]


def test_relay(spark):
    columns = ["key", "at", "at_ms", "event", "text", "terminal", "duration_ms"]
    rows = [("i", 0, 0, "enqueue", None, False, 1000), ("i", 1, 1, "failed", None, False, 0), ("i", 2, 500, "ok", "too early", False, 0), ("i", 3, 1500, "ok", "a transcript", False, 0), ("i", 4, 1600, "ok", "{}", False, 0), ("i", 5, 1700, "ok", "ignored", False, 0), ("i", 6, 1800, "review", "accepted", False, 0), ("i", 7, 1900, "failed", None, True, 0), ("i", 8, 2000, "reopen", None, False, 0), ("i", 9, 2100, "review", "edited", False, 0), ("i", 10, 2200, "ok", None, False, 0), ("i", 11, 2300, "reopen", None, False, 0)]
    got = fold(spark, P.relay(), rows, columns)
    assert [x[1] for x in got] == ["queued", "failed", "extracting", "awaiting-review", "writing", "dead", "awaiting-review", "writing", "done"]
    assert got[1][2:] == (1, 1001)
    dead = fold(spark, P.relay(), [("i", 0, 0, "enqueue", None, False, 0)] + [("i", k, k * 10**6, "failed", None, False, 0) for k in range(1, 12)], columns)
    assert [x[1] for x in dead] == ["queued", *["failed"] * 7, "dead"]


def test_previews_and_connectivity(spark):
    rows = [("i", 0, "tail", "a", 1), ("i", 1, "tail", "ab", 1), ("i", 2, "commit", "ab.", 1), ("i", 3, "tail", "old", 0), ("i", 4, "commit", "", 1), ("i", 5, "handoff", None, 1), ("i", 6, "tail", "late", 1)]
    got = fold(spark, P.previews(), rows, ["key", "at", "event", "text", "session"])
    assert got == [(0, None, "a", False), (0, None, "ab", False), (1, "ab.", None, False), (2, "", None, False), (0, None, None, True)]
    rows = [("d", t, t, e) for t, e in [(0, "up"), (100, "probe_ok"), (3200, "down"), (4000, "up"), (10_000, "up"), (10_100, "probe_ok"), (11_000, "down")]]
    got = fold(spark, P.connectivity(), rows, ["key", "at", "at_ms", "event"])
    assert got == [(0, "probing"), (3100, "online"), (3200, "offline"), (4000, "probing"), (9000, "offline"), (10_000, "probing"), (11_000, "offline")]


def test_agreement(spark):
    got = fold(spark, P.agreement(2), [("s", k, t) for k, t in enumerate(["a b c", "a b d", "a b d e", "x"])], ["key", "at", "text"])
    assert got == [("a b", 2), ("d", 3)]


def test_stream_and_replay_agree(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = lambda d: d.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("frame"), (F.col("value") / 200).alias("p"))
    processor = P.live_regions(refresh=1, commit=2, least=4, cap=10, speech=1, pad=1)
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    got = drained(streamed(pick(stream), "user_id", ["frame"], processor), shared_folder(spark, "test"))
    want = replayed(pick(table), "user_id", ["frame"], processor)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
