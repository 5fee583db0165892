"""The write sink over a stream that breaks off between the write and the ledger."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.sources.folders import Files
from attestra.sources.write_sink import KEY, Adapter, WriteSink, folder_writer, tool_rows

VALUES = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("state", T.StringType())])
CONTEXT = T.StructType([T.StructField("job", T.StringType())])


def adapter(write=lambda rows, batch: None, **more):
    return Adapter("test", VALUES, CONTEXT, write, **more)


def test_problems(spark):
    cases = {
        '{"price": 1, "state": "x"}|{"job": "j"}': None, '{"state": null}|{"job": "j", "user": 1}': None, '{"price": 1.5}|{}': "context lacks job", '{"price": 1}|{"job": 5}': "context has wrong job", "{}|{": "context is no object",
        '{}|{"job": "j"}': "nothing to write", '[1]|{"job": "j"}': "fields are no object", '{"odd": 1, "price": 2}|{"job": "j"}': "unknown fields odd", '{"price": "much"}|{"job": "j"}': "wrong fields price",
    }
    rows = [(k, *case.split("|"), case) for k, case in enumerate(cases)] + [(99, None, '{"job": "j"}', "null")]
    got = adapter().checked(spark.createDataFrame(rows, "id long, fields string, context string, name string")).collect()
    assert {r.name: r.problem for r in got} == cases | {"null": "fields are no object"}
    assert adapter(required_on_create=("price",)).checked(spark.createDataFrame([(1, '{"state": "x"}', '{"job": "j"}')], "id long, fields string, context string")).first().problem == "fields lack price"
    with pytest.raises(ValueError, match="no such fields: cost"):
        adapter(required_on_create=("cost",))
    assert [f.name for f in adapter().extraction_schema()["price"].dataType] == ["value", "confidence", "source_span"]


def rows_of(spark, path, first, n):
    rows = [(i, json.dumps({"price": float(i)}), json.dumps({"job": f"j{i % 3}"}), f"k{i % 70}") for i in range(first, first + n)]
    spark.createDataFrame(rows, f"id long, fields string, context string, {KEY} string").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(f"id long, fields string, context string, {KEY} string").option("maxFilesPerTrigger", 1).parquet(path)


def test_each_key_is_there_once_whatever_breaks(spark, tmp_path):
    source, tool = str(tmp_path / "source"), str(tmp_path / "tool")
    for first in (0, 40, 80):
        rows_of(spark, source, first, 40)
    broken = []

    def breaks(batch):
        if len(broken) < 2:
            broken.append(batch)
            raise RuntimeError("lost power")

    make = lambda **more: WriteSink(spark, str(tmp_path / "sink"), adapter(folder_writer(tool)), **more)
    one = make(after_write=breaks)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            one.start(stream(spark, source), str(tmp_path / "checkpoint")).awaitTermination()
    assert broken[0] == broken[1] and one.ledger().isEmpty()  # written, but not in the ledger: the batch runs again under its name
    assert tool_rows(one, tool, spark.read.parquet(tool).drop("batch").schema).isEmpty()
    one.start(stream(spark, source), str(tmp_path / "checkpoint")).awaitTermination()
    schema = spark.read.parquet(tool).drop("batch").schema
    want = {f"k{k}": (k, f"j{k % 3}") for k in range(70)}
    found = lambda sink: [(r[KEY], (r.id, r.context.job)) for r in tool_rows(sink, tool, schema).collect()]
    assert len(found(one)) == 70 and dict(found(one)) == want
    # another stream from the beginning: nothing is written twice
    two = make()
    two.start(stream(spark, source), str(tmp_path / "other")).awaitTermination()
    assert len(found(two)) == 70 and two.ledger().count() == 70
    # and what comes later is
    rows_of(spark, source, 200, 5)
    spark.createDataFrame([(999, '{"price": 1}', "{}", "new")], f"id long, fields string, context string, {KEY} string").write.mode("append").parquet(source)
    two.start(stream(spark, source), str(tmp_path / "other")).awaitTermination()
    assert len(found(two)) == 70 and [r.problem for r in two.refused().collect()] == ["context lacks job"]


def test_a_batch_in_the_ledger_is_done_with(spark, tmp_path):
    calls = []
    sink = WriteSink(spark, str(tmp_path / "sink"), adapter(lambda rows, batch: calls.append((batch, rows.count()))))
    rows = spark.createDataFrame([(1, '{"price": 1}', '{"job": "j"}', "a"), (2, '{"price": 2}', '{"job": "j"}', "a")], f"id long, fields string, context string, {KEY} string")
    sink.write(rows, "b1")
    sink.write(rows, "b1")
    sink.write(rows, "b2")
    sink.write(rows.limit(0), "b3")
    assert calls == [("b1", 1), ("b2", 0), ("b3", 0)] and sink.ledger().count() == 1


def test_put_new_lets_one_win(spark, tmp_path):
    files, at = Files(spark), f"file://{tmp_path}/v/1.json"
    assert files.put_new(at, "one") and not files.put_new(at, "two")
    assert files.read(at) == "one" and files.names(f"file://{tmp_path}/v") == ["1.json"]
    assert [x for x in os.listdir(tmp_path / "v") if not x.startswith(".")] == ["1.json"]
