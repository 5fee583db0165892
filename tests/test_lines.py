"""The line source against plain Python, with ranges of a few bytes, and as a stream over growing files."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.sources import json_text as J
from attestra.sources.lines import files_written, line_stream, lines, numbered


def test_lines_match_plain_python(spark, tmp_path):
    rnd = random.Random(1)
    want = []
    for k in range(3):
        text = "".join(rnd.choice(["\n", "\n", "a", "bc", "é", "x" * 30, "\r"]) for _ in range(30))
        data = text.encode()
        (tmp_path / f"f{k}.log").write_bytes(data)
        at = 0
        parts = data.split(b"\n")
        for n, line in enumerate(parts, 1):
            if n < len(parts) or line:
                want.append((f"f{k}.log", at, n, line.decode()))
            at += len(line) + 1
    (tmp_path / "_hidden.log").write_text("no")
    (tmp_path / "other.txt").write_text("no")
    for size in (3, 11, 50, 10**6):
        got = numbered(lines(spark, str(tmp_path), "*.log", size)).collect()
        assert sorted((r.file.split("/")[-1], r.offset, r.line, r.text) for r in got) == sorted(want)
    assert lines(spark, str(tmp_path / "f0.log")).count() == sum(x[0] == "f0.log" for x in want)
    assert lines(spark, str(tmp_path / "none")).count() == 0


def test_policies_for_malformed_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"n": 1}\n\n  \n{"n": 2}\n[3]\nbroken\n{"n": 4}')
    at = f"file://{tmp_path}/h.jsonl"
    for size in (5, 10**6):
        kept = J.json_lines(spark, at, "n int", "keep", range_bytes=size).collect()
        assert sorted((r.line, r.n, r.problem is None) for r in kept) == [(1, 1, True), (4, 2, True), (5, None, False), (6, None, False), (7, 4, True)]
    assert sorted(r.n for r in J.json_lines(spark, at, "n int", "drop").collect()) == [1, 2, 4]
    with pytest.raises(Exception, match="malformed line [56] of"):
        J.json_lines(spark, at, "n int").collect()
    with pytest.raises(ValueError):
        J.json_lines(spark, at, "n int", "skip")


def test_a_stream_takes_lines_once_they_are_ended(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def run():
        stream = J.marked_lines(line_stream(spark, str(log), range_bytes=9).select("file", "text"), "@@M@@ ", "n int")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.n for r in spark.read.schema("file string, n int").parquet(f"{tmp_path}/out").collect())

    one = log / "one.log"
    one.write_text('noise\n12:00 @@M@@ {"n": 1}\n@@M@@ {"n"')
    assert run() == [1]
    with one.open("a") as f:
        f.write(': 2}\n@@M@@ {bad\n')
    (log / "two.log").write_text('@@M@@ {"n": 3}\n@@M@@ {"n": 4}')
    assert run() == [1, 2, 3]
    with (log / "two.log").open("a") as f:
        f.write("\n")
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]


def test_named_files_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a b/c", '{"leaves": {}}'), ("é", '{"old": 1}'), ("x", "{"), ("y", '{"leaves": 1}'), ("z", "[1]")], "name string, text string")
    files_written(rows, f"file://{tmp_path}/truth", ".json")
    files_written(rows.where("name != 'y'").withColumn("text", F.concat(F.lit("said "), "name")), f"file://{tmp_path}/texts", ".txt")
    got = J.truth_files(spark, f"file://{tmp_path}/truth", f"file://{tmp_path}/texts", spark.createDataFrame([("z",)], "slug string")).collect()
    assert {r.slug: (r.problem, r.text) for r in got} == {"a b/c": (None, "said a b/c"), "é": ("old format", "said é"), "x": ("malformed", "said x"), "y": ("no transcript", None)}
    files_written(rows.withColumn("text", F.lit("new")), f"file://{tmp_path}/truth", ".json")
    assert {r.truth for r in J.named_texts(spark, f"file://{tmp_path}/truth/*.json", "truth").collect()} == {"new"}
