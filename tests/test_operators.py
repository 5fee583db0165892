import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators import queue as Q
from attestra.operators import regions as R
from attestra.operators import review as V
from attestra.operators import scoring as C


def regions_of(p, onset, leave):
    out, at = [], None
    for k, x in enumerate(p):
        if at is None:
            at = k if x >= onset else None
        elif x < leave:
            out.append([at, k])
            at = None
    return out + ([[at, len(p)]] if at is not None else [])


def planned(p, gap, least, pad, span):
    found = []
    for a, b in regions_of(p, 0.5, 0.35):
        if found and a - found[-1][1] < gap:
            found[-1][1] = b
        else:
            found.append([a, b])
    found = [x for x in found if x[1] - x[0] >= least]
    wide = [[max(0, a - pad), min(len(p), b + pad)] for a, b in found]
    for k in range(1, len(wide)):
        if wide[k - 1][1] > wide[k][0]:
            wide[k - 1][1] = wide[k][0] = (found[k - 1][1] + found[k][0]) // 2
    merged = []
    for a, b in wide:
        if merged and b - merged[-1][0] <= span:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return found, wide, merged


def test_regions_match_a_scan(spark):
    rnd = random.Random(7)
    streams = {s: [rnd.choice([0.1, 0.3, 0.4, 0.45, 0.6, 0.9]) for _ in range(rnd.randint(1, 90))] for s in range(25)}
    frames = spark.createDataFrame([(s, k, x) for s, p in streams.items() for k, x in enumerate(p)], "stream long, frame long, p double")
    lengths = spark.createDataFrame([(s, len(p)) for s, p in streams.items()], "stream long, length long")
    kept = R.long_enough(R.bridged(R.binarized(frames), 3), 2)
    wide = R.padded(kept, 2, lengths)
    merged = R.merged(wide, 20)
    cut = R.cut(merged, frames, 8).collect()
    for s, p in streams.items():
        want = planned(p, 3, 2, 2, 20)
        for df, w in zip((kept, wide, merged), want):
            assert sorted([r.start, r.end] for r in df.where(F.col("stream") == s).collect()) == w
        mine = sorted((r.start, r.end) for r in cut if r.stream == s)
        assert all(b - a <= 8 for a, b in mine) and sum(b - a for a, b in mine) == sum(b - a for a, b in want[2])
    with pytest.raises(ValueError):
        R.binarized(frames, 0.3, 0.5)


def test_cut_takes_the_first_quietest_frame_of_the_middle():
    assert R._cut([0.1, 0.9, 0.2, 0.2, 0.9, 0.0], 10, 4) == [(10, 12), (12, 16)]


def test_windows(spark):
    lengths = spark.createDataFrame([(1, 0), (2, 30), (3, 31), (4, 95)], "stream long, n long")
    got = sorted((r.stream, r.start, r.end) for r in R.overlapping_windows(lengths, 30, 20).collect())
    assert got == [(2, 0, 30), (3, 0, 30), (3, 20, 31), (4, 0, 30), (4, 20, 50), (4, 40, 70), (4, 60, 90), (4, 80, 95)]


def cell(**kw):
    row = {"slug": "a", "path": "g.x", "kind": "enum", "is_health": False, "is_band": False, "truth": None, "value": None, "source_span": None, "alternatives": [], "retracted": [], "acceptable_miss": False, "text": "it is so", "confidence": 0.5}
    return row | kw


CASES = [
    (cell(), "correct-null"), (cell(value="x", alternatives=["x"]), "soft"), (cell(value="x"), "hallucination"), (cell(is_health=True, value="Not Tested"), "silent-not-tested"), (cell(is_health=True, value="Passed"), "health-hallucinated-pass"), (cell(is_health=True, value="Failed"), "health-hallucinated-problem"),
    (cell(truth="x"), "miss"), (cell(truth="x", acceptable_miss=True), "excused"), (cell(truth="Passed", is_health=True), "health-miss"), (cell(truth="x", value="x"), "correct"), (cell(truth="x", value="y"), "wrong"), (cell(truth="x", value="y", alternatives=["y"]), "sanctioned"),
    (cell(truth="x", value="y", retracted=["y"]), "retracted"), (cell(truth="Passed", value="Passed", is_health=True), "health-correct"), (cell(truth="Failed", value="Passed", is_health=True), "health-hallucinated-pass"), (cell(truth="Failed", value="Warning", is_health=True), "health-wrong-state"),
    (cell(kind="number", truth="5", value="5.0000001"), "correct"), (cell(kind="number", truth="5", value="many"), "unscorable"), (cell(kind="string", truth="Gas Furnace", value="gas-furnace!"), "correct"), (cell(kind="string", truth="ab", value="a"), "wrong"),
]


def test_decision_table(spark):
    rows = [c | {"slug": str(k)} for k, (c, _) in enumerate(CASES)]
    schema = "slug string, path string, kind string, is_health boolean, is_band boolean, truth string, value string, source_span string, alternatives array<string>, retracted array<string>, acceptable_miss boolean, text string, confidence double"
    judged = C.verdict(spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema))
    got = {int(r.slug): r for r in judged.collect()}
    assert [got[k].verdict for k in range(len(CASES))] == [v for _, v in CASES]
    assert {r.span_issue for r in got.values()} == {None, "missing"} and all(r.bucket for r in got.values())
    t = C.totals(judged).first()
    assert t.gt_null == 3 and t.h_gt_null == 3 and t.hallucination_rate == 1 / 3 and t.miss == 1 and t.miss_rate == 1 / (t.gt_non_null - 1)
    assert C.totals(judged.where("false")).first().miss_rate is None


def test_due_head_blocks(spark):
    schema = "id string, seq long, status string, next_attempt_at timestamp"
    rows = [("a", 3, "queued", None), ("b", 1, "failed", datetime.datetime(2024, 1, 2)), ("c", 0, "done", None)]
    now = lambda d: F.lit(d).cast("timestamp")
    items = spark.createDataFrame(rows, schema)
    assert Q.due(items, now("2024-01-01")).collect() == [] and [r.id for r in Q.due(items, now("2024-01-03")).collect()] == ["b"]
    blocked = items.union(spark.createDataFrame([("d", 9, "recording", None)], schema))
    assert Q.due(blocked, now("2024-01-03")).collect() == [] and Q.head(items.where("status = 'done'")).collect() == []


def test_enveloped_schemas():
    values = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.DoubleType())])), T.StructField("c", T.StringType())])
    assert V.leaf_paths(V.enveloped(values)) == ["a.b", "c"]
    for bad in (T.StructField("x", T.ArrayType(T.StringType())), T.StructField("x.y", T.StringType()), T.StructField("7", T.StringType())):
        with pytest.raises(ValueError):
            V.enveloped(T.StructType([bad]))


def test_review(spark):
    leaves = spark.createDataFrame([("i", "a", 0, "1"), ("i", "b", 1, None), ("j", "a", 0, "2")], "item_id string, path string, ord int, value string")
    decisions = spark.createDataFrame([("i", "a", "edited", "9"), ("i", "b", "rejected", None), ("j", "a", "rejected", None), ("j", "z", "accepted", None)], "item_id string, path string, status string, value string")
    assert sorted((r.item_id, r.path, r.value) for r in V.resolved(leaves, decisions).collect()) == [("i", "a", "9")]
    assert {r.item_id: (r.status, r.edited_fields, r.rejected_fields) for r in V.outcomes(leaves, decisions).collect()} == {"i": ("edited", ["a"], ["b"]), "j": ("discarded", [], ["a"])}
    assert [(r.item_id, r.path, r.issue) for r in V.completeness(leaves, decisions).collect()] == [("j", "z", "extra")]
    wide = V.nested(leaves.where("item_id = 'i'"), V.enveloped(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
    assert wide.first().fields.asDict() == {"a": "1", "b": None}


def test_new_numbers_need_no_single_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = random.Random(4).sample(range(100_000), 3000)
        got = Q.with_seq(spark.createDataFrame([(7,), (41,)], "seq long"), spark.createDataFrame([(i,) for i in ids], "id long"), "id")
        assert got.columns == ["id", "seq"]
        found = got.withColumn("task", F.spark_partition_id()).collect()
        assert {r.id: r.seq for r in found} == {i: 42 + k for k, i in enumerate(sorted(ids))}
        assert len({r.task for r in found}) > 1
        assert Q.with_seq(spark.createDataFrame([], "seq long"), spark.createDataFrame([(5,), (3,)], "id long"), "id").orderBy("id").collect() == [(3, 0), (5, 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
