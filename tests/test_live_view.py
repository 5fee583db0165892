"""A view kept up by changes, and frames, over streams of several batches."""

import random

from pyspark.sql import functions as F

from attestra.sources.folders import shared_folder
from attestra.streaming import processors as P
from attestra.streaming.folds import streamed
from attestra.streaming.live_view import LiveView, retractions
from attestra.streaming.timed import timed

SCHEMA = "id string, at long, status string, total long, deleted boolean"


def test_the_view_follows_and_so_do_the_bytes(spark, tmp_path):
    rnd = random.Random(2)
    view = LiveView(spark, shared_folder(spark, "view"), ["status"], ["total"], most_parts=4)
    now, at, sizes = {}, 0, []
    written = view.versions.write
    view.versions.write = lambda rows, by=None: sizes.append(rows.count()) or written(rows, by)
    for batch in range(6):
        rows = []
        for _ in range(40 if batch == 0 else 3):
            at += 1
            i, status, n, gone = f"i{rnd.randint(0, 9)}", rnd.choice("abcdefgh") if batch == 0 else "a", rnd.randint(0, 5), rnd.random() < 0.1
            rows.append((i, at, status, n, gone))
            now[i] = None if gone else (status, n)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        view.start(streamed(stream, "id", ["at"], retractions({"status": "string", "total": "long"})), f"{tmp_path}/state").awaitTermination()
        want = {}
        for status, n in filter(None, now.values()):
            want[status] = (want.get(status, (0, 0))[0] + 1, want.get(status, (0, 0))[1] + n)
        assert {r.status: (r.n, r.total) for r in view.read().collect()} == want
    assert sizes[0] > 3 and all(n <= 4 for n in sizes[1:4])  # a later batch writes the groups that its three rows touch


def test_a_batch_is_added_once(spark):
    view = LiveView(spark, shared_folder(spark, "view"), ["status"], ["total"], most_parts=2)
    changes = spark.createDataFrame([("a", 1.5, 1), ("a", 2.0, 1), ("b", 1.0, 1), (None, 1.0, 1), ("c", 1.0, 1), ("c", 1.0, -1)], "status string, total double, sign long")
    for _ in range(2):
        view.add(changes, "one")
    want = {"a": (2, 3.5), "b": (1, 1.0), None: (1, 1.0)}
    read = lambda: {r.status: (r.n, r.total) for r in view.read().collect()}
    assert read() == want
    view.add(spark.createDataFrame([("b", 1.0, -1)], "status string, total double, sign long"), "two")
    view.add(spark.createDataFrame([], "status string, total double, sign long"), "three")
    del want["b"]
    assert read() == want and view.versions.parts()[""]  # made one meanwhile
    view.add(changes, "one")
    assert read() == want


def test_frames_are_the_same_however_the_input_is_cut(spark, tmp_path):
    rnd = random.Random(4)
    quanta = [("s" if k % 3 else "t", 1000 + k, [float(x) for x in range(k * 10, k * 10 + rnd.randint(0, 5))]) for k in range(40)]
    schema = "stream string, at long, samples array<double>"
    for cuts in ([40], [7, 20, 21, 40], [1, 2, 3, 40]):
        folder, begin = tmp_path / "-".join(map(str, cuts)), 0
        for end in cuts:
            spark.createDataFrame(quanta[begin:end], schema).withColumn("time", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            begin = end
            stream = spark.readStream.schema(schema + ", time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            found = timed(stream, "stream", ["at"], P.reframed(4), "time", "at", 1000)
            found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        got = {(r.stream, r.frame): list(r.samples) for r in spark.read.parquet(f"{folder}/out").collect()}
        want = {}
        for s in "st":
            samples = [x for q, _, xs in quanta if q == s for x in xs]
            want |= {(s, k): samples[4 * k : 4 * k + 4] for k in range(len(samples) // 4)}
        assert got == want
