"""The queue's writes on small tables, against plain Python."""

import random

from pyspark.sql import functions as F

from attestra.functions.structures import _aligned
from attestra.operators import queue as Q
from attestra.operators import regions as R
from attestra.operators import writes as W


def test_folded_matches_plain_python(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 6), v, rnd.choice([None, None, "x", "y"]), rnd.choice([None, 1, 2]), rnd.choice([None, [], ["a"], ["n", "a"]]), rnd.random() < 0.1) for v in range(80)]
    log = spark.createDataFrame(rows, "id long, version long, a string, n long, unset array<string>, deleted boolean")
    want = {}
    for i, _, a, n, unset, deleted in rows:
        item = want.setdefault(i, {"a": None, "n": None, "gone": False})
        if deleted or item["gone"]:
            item.update(a=None, n=None)
        for name, v in () if deleted else (("a", a), ("n", n)):
            if v is not None:
                item[name] = v
            elif name in (unset or []):
                item[name] = None
        item["gone"] = deleted
    got = {r.id: (r.a, r.n) for r in W.folded(log, ["a", "n"]).collect()}
    assert got == {i: (x["a"], x["n"]) for i, x in want.items() if not x["gone"]}


def test_keys_are_fresh_and_empty_tables_stay_empty(spark):
    items = spark.createDataFrame([], "id string, seq long, status string")
    new = spark.createDataFrame([(f"i{k}",) for k in range(30)], "id string")
    got = W.enqueued(items, new, "id", F.lit("2020-01-01").cast("timestamp_ntz")).collect()
    assert len({r.idempotency_key for r in got}) == 30 and sorted(r.seq for r in got) == list(range(30))
    assert W.enqueued(items, new.limit(0), "id", F.lit(None).cast("timestamp_ntz")).count() == 0


def test_numbered_in_order(spark):
    rows = spark.createDataFrame([(x, str(x)) for x in random.Random(1).sample(range(5000), 700)], "a long, b string")
    got = sorted(Q.numbered(rows, ["a"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 701)) and [r.a for r in got] == sorted(r.a for r in got)


def test_alignment_matches_the_whole_table():
    rnd = random.Random(5)
    for _ in range(400):
        ref, hyp = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        n, m = len(ref), len(hyp)
        t = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
        sub, gone, ins, pairs = _aligned(ref, hyp)
        assert sub + gone + ins == t[n][m] and len(pairs) == sub and n - gone == m - ins


def test_cut_matches_one_region_at_a_time(spark):
    rnd = random.Random(7)
    frames = {s: [rnd.choice([0.1, 0.2, 0.5, 0.9]) for _ in range(120)] for s in "ab"}
    regions = [("a", 0, 50), ("a", 50, 57), ("a", 60, 119), ("b", 3, 120)]
    f = spark.createDataFrame([(s, k, p) for s, x in frames.items() for k, p in enumerate(x)], "stream string, frame long, p double")
    r = spark.createDataFrame(regions, "stream string, start long, end long")
    want = sorted((s, *x) for s, a, b in regions for x in (R._cut(frames[s][a:b], a, 9) if b - a > 9 else [(a, b)]))
    assert sorted(tuple(x) for x in R.cut(r, f, 9).collect()) == want


def test_an_item_that_is_written_again_begins_anew(spark):
    log = spark.createDataFrame([("x", 1, "queued", 5, False), ("x", 2, None, None, True), ("x", 3, "fresh", None, False), ("y", 1, "queued", 6, False), ("y", 2, None, None, True)], "id string, version long, status string, n long, deleted boolean")
    got = W.folded(log.withColumn("unset", F.lit(None).cast("array<string>")), ["status", "n"]).collect()
    assert [tuple(r) for r in got] == [("x", "fresh", None)]


def test_recovered_items_are_whole(spark):
    items = spark.createDataFrame([("a", 0, "recording", "s", "house 1", "t"), ("b", 1, "recording", None, "house 2", None), ("c", 2, "queued", None, "house 3", None)], "id string, seq long, status string, source_id string, job string, transcript string")
    chunks = spark.createDataFrame([("a", "c0", b"ok"), ("a", "c1", b"no")], "id string, name string, bytes binary")
    decode = lambda b: F.when(b.cast("string").endswith("ok"), F.length(b).cast("long"))
    changes, new = W.recovered(items, chunks, decode, "seq", F.lit("2020-01-01").cast("timestamp_ntz"))
    (one,) = new.collect()
    assert (bytes(one.audio), one.duration_ms, one.job, one.status, one.attempts, one.seq) == (b"ok", 2, "house 1", "queued", 0, 3)
    assert len(one.idempotency_key) == 36 and one.next_attempt_at == one.enqueued_at and "transcript" not in one and "source_id" not in one
    assert {r.id: r.last_error for r in changes.collect()} == {"a": f"recovered as {one.id}", "b": "unrecoverable: no capture.sourceId"}
