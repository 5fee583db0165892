"""A batch run that is taken up again, declared constraints, and captures joined with health."""

import pytest
from pyspark.sql import functions as F

from attestra.operators.constraints import Constraints, violations
from attestra.sources.batch_runner import BatchRunner
from attestra.sources.folders import shared_folder
from attestra.streaming.captures import health_in_captures, of_the_last_registered


def test_a_run_that_breaks_off_and_its_second_equal_a_whole_one(spark):
    def work(text):
        if "bad" in text:
            raise ValueError("bad text")
        return text.upper()

    inputs = spark.createDataFrame([(f"s{k}", f"text {k} {'bad' if k % 7 == 0 else ''}") for k in range(40)] + [("null", None), (None, "no name"), ("s1", "zzz")], "slug string, text string")
    whole = BatchRunner(spark, shared_folder(spark, "batch"), work)
    first = whole.run(inputs).collect()
    assert {(r.slug, r.status) for r in first} == {(f"s{k}", "failed" if k % 7 == 0 else "ok") for k in range(40)} | {("null", "ok")}

    def breaks(wave):
        if wave == 5:
            raise RuntimeError("lost power")

    root = shared_folder(spark, "batch")
    broken = BatchRunner(spark, root, work, before_wave=breaks)
    with pytest.raises(RuntimeError):
        broken.run(inputs)
    done = {r.slug for r in broken.results().where("status = 'ok'").collect()}
    assert 0 < len(done) < 35
    second = BatchRunner(spark, root, work)
    manifest = {r.slug: r.status for r in second.run(inputs).collect()}
    assert {s for s, x in manifest.items() if x == "skipped"} == done
    rows = lambda r: sorted(map(tuple, r.results().collect()), key=str)
    assert rows(second) == rows(whole) and len(rows(whole)) == 41
    assert {x for _, x, _, _ in rows(whole)} == {"ok", "failed"}
    # failures are tried again; forced, everything is
    mended = BatchRunner(spark, root, str.upper)
    assert {r.status for r in mended.run(inputs).collect()} == {"ok", "skipped"} and mended.results().where("status != 'ok'").isEmpty()
    assert {r.status for r in mended.run(inputs, force=True).collect()} == {"ok"}
    assert mended.run(inputs.limit(0)).isEmpty()


def test_violations(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (2, "b", "y"), (3, None, "x"), (None, None, None)]
    cells = spark.createDataFrame(rows, "run long, path string, slug string")
    for approximate in (False, True):
        declared = Constraints(("path",), (("path", "slug"),), (("path", "slug"),), approximate)
        got = {(r.run, r.problem): r.n for r in violations(cells, ["run"], declared).collect()}
        assert got == {(2, "not unique: path, slug"): 1, (2, "not dense: path, slug"): 2, (3, "no path"): 1, (None, "no path"): 1}
    assert violations(cells.limit(0), ["run"], declared).isEmpty()
    many = spark.range(60_000).select(F.lit(1).alias("run"), F.col("id").cast("string").alias("path"), F.lit("s").alias("slug"))
    assert violations(many, ["run"], declared).isEmpty()
    twice = violations(many.union(many), ["run"], Constraints(unique=(("path",),), approximate=True)).collect()
    assert len(twice) == 1 and abs(twice[0].n - 60_000) < 3000


def test_health_counts_for_the_active_capture(spark, tmp_path):
    t = lambda m: f"2020-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    captures = [("d", 1, t(0), t(30)), ("d", 2, t(10), t(20)), ("e", 3, t(0), t(5))]
    health = [("d", k, t(m), h) for k, (m, h) in enumerate([(0, "flushing"), (12, "stalled"), (20, "flushing"), (30, "late")])] + [("e", 9, t(6), "none"), ("f", 10, t(1), "other")]
    streams = []
    for name, rows, schema, times in (("c", captures, "device string, capture long, begin string, end string", ("begin", "end")), ("h", health, "device string, event long, at string, health string", ("at",))):
        frame = spark.createDataFrame(rows, schema).withColumns({x: F.col(x).cast("timestamp") for x in times})
        frame.write.parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/{name}"))
    joined = health_in_captures(*streams)
    joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = of_the_last_registered(spark.read.schema(joined.schema).parquet(f"{tmp_path}/out"), ["device", "event"]).collect()
    assert sorted((r.device, r.event, r.capture, r.health) for r in got) == [("d", 0, 1, "flushing"), ("d", 1, 2, "stalled"), ("d", 2, 1, "flushing")]
