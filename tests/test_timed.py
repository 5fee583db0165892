"""Timers and ends of states, over a stream of several batches."""

import json

from pyspark.sql import functions as F

from attestra.streaming import processors as P
from attestra.streaming.timed import timed

SCHEMA = "key string, at_ms long, event string"


class Stream:
    def __init__(self, spark, folder, processor, schema, emits, idle_ms=60_000):
        self.spark, self.folder, self.processor, self.schema, self.emits, self.idle_ms = spark, str(folder), processor, schema, emits, idle_ms

    def put(self, *rows):
        """Events of one batch; gives the rows that it brought, how many states there are after it, and the watermark."""
        made = self.spark.createDataFrame(rows, self.schema).withColumn("time", F.timestamp_millis("at_ms"))
        made.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        before = self.rows()
        query = timed(stream, "key", ["at_ms"], self.processor, "time", "at_ms", self.idle_ms).writeStream.outputMode("append").format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        last = json.loads(query.recentProgress[-1].json)
        return sorted(set(self.rows()) - set(before)), last["stateOperators"][0]["numRowsTotal"]

    def rows(self):
        try:
            return [tuple(r) for r in self.spark.read.schema(f"key string, {self.emits}").parquet(f"{self.folder}/out").collect()]
        except Exception:
            return []


def test_timers_fire_without_a_further_event(spark, tmp_path):
    s = Stream(spark, tmp_path, P.connectivity(), SCHEMA, "at_ms long, status string")
    got, n = s.put(("a", 1000, "up"), ("a", 2000, "probe_ok"), ("b", 1000, "up"), ("c", 1000, "up"), ("z", 1000, "down"))
    assert got == [("a", 1000, "probing"), ("b", 1000, "probing"), ("c", 1000, "probing")] and n == 4
    got, n = s.put(("c", 3000, "probe_failed"), ("x", 5500, "down"))
    assert got == [("a", 5000, "online"), ("c", 3000, "offline")]  # time has come to 5500: b's probe may still answer
    got, n = s.put(("x", 9000, "down"))
    assert got == [("b", 6000, "offline")] and n == 5
    # what rests goes a minute after its last event; a is online and stays
    got, n = s.put(("x", 300_000, "down"))
    assert got == [] and n == 2
    got, n = s.put(("b", 300_500, "up"), ("a", 300_600, "down"))
    assert got == [("a", 300_600, "offline"), ("b", 300_500, "probing")]


def test_timed_and_replayed_agree_whatever_the_batches(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = sorted((rnd.choice("abcd"), t, rnd.choice(["up", "down", "probe_ok", "probe_failed", "up", "probe_ok"])) for t in rnd.sample(range(0, 120_000, 7), 90))
    rows.sort(key=lambda r: r[1])
    s = Stream(spark, tmp_path, P.connectivity(), SCHEMA, "at_ms long, status string", idle_ms=2000)
    for k in range(0, 90, 30):
        s.put(*rows[k : k + 30])
    s.put(("end", 10**6, "down"))
    want, states = [], {}
    processor = P.connectivity()
    for key, at, event in [*rows, *((k, 10**6, "none") for k in "abcd")]:
        state = states.setdefault(key, dict(processor.start))
        want += [(key, x["at_ms"], x["status"]) for x in processor.step(state, {"at_ms": at, "event": event})]
    assert sorted(s.rows()) == sorted(want)


def test_previews_hold_counts_and_end(spark, tmp_path):
    s = Stream(spark, tmp_path, P.previews(), SCHEMA + ", text string, session long", "n_committed long, added string, tail string, done boolean")
    got, _ = s.put(("i", 1, "tail", "a", 1), ("i", 2, "commit", "long text " * 1000, 1), ("i", 3, "commit", "b", 1), ("j", 3, "tail", "x", 1))
    assert len(got) == 4
    got, n = s.put(("i", 10, "handoff", None, 1), ("j", 11, "tail", "xy", 1), ("i", 12, "tail", "late", 1))
    assert got == [("i", 0, None, None, True), ("j", 0, None, "xy", False)] and n == 2
    _, n = s.put(("j", 200_000, "tail", "xyz", 1))
    assert n == 1


def test_whole_previews_show_all_committed_text(spark, tmp_path):
    s = Stream(spark, tmp_path, P.previews(whole=True), SCHEMA + ", text string, session long", "n_committed long, text string, tail string, done boolean")
    got, _ = s.put(("i", 1, "tail", "c", 1), ("i", 2, "commit", "a b.", 1), ("n", 2, "commit", None, 1), ("i", 3, "commit", None, 1))
    assert got == [("i", 0, "", "c", False), ("i", 1, "a b.", None, False), ("i", 2, "a b.", None, False), ("n", 1, None, None, False)]
    got, _ = s.put(("i", 10, "commit", "", 1), ("i", 11, "commit", "d", 1))  # what earlier batches committed is there
    assert got == [("i", 3, "a b. ", None, False), ("i", 4, "a b.  d", None, False)]
    got, _ = s.put(("i", 20, "handoff", None, 1), ("i", 21, "commit", "late", 1))
    assert got == [("i", 0, "", None, True)]


def test_the_preview_query_shows_whole_texts(spark, sf_dir):
    from attestra.plans.catalogue import QUERIES

    got = QUERIES["stm_previews"](spark, sf_dir)
    assert got.columns == ["user_id", "n_committed", "text", "tail", "done"]
    rows = got.collect()
    assert max(r.n_committed for r in rows) > 1
    assert all(r.text.count('"k"') == r.n_committed for r in rows)
