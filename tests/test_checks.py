from pyspark.sql import types as T

from attestra.operators import checks as K
from attestra.operators import extraction as X
from attestra.sources import json_text as J


def test_schemas():
    group = lambda name: T.StructField(name, T.StructType([T.StructField("x", T.StringType())]))
    assert list(K.split_by_group(T.StructType([group("a"), group("b")]))) == ["a", "b"]
    assert K.split_by_group(T.StructType([group("a"), T.StructField("y", T.StringType())])) is None
    spec = {"description": "d", "properties": {"description": {"type": "string", "description": "d"}}, "items": [{"description": "e"}]}
    assert K.without_descriptions(spec) == {"properties": {"description": {"type": "string"}}, "items": [{}]}


def test_symmetric_members(spark):
    schema = "kind string, status string, source_span string, value string, member string, no_fit string, options array<string>, alternatives array<string>, note string, symmetric boolean, text string"
    row = lambda member, others, note="n": ("enum", "asserted", "it", None, member, None, ["a", "b", "c"], others, note, True, "it is")
    got = K.truth_problems(spark.createDataFrame([row("a", ["b"]), row("b", ["a"]), row("a", []), row("a", ["z"], "")], schema)).collect()
    assert [r.problems for r in got] == [[], ["member not the earliest"], ["symmetric without alternatives"], ["alternatives without a note", "alternative not a member"]]


def test_messages():
    target = X.Target(("a", "b"), "do it", (("one", {"a": 1}),), {"a": "mind a"})
    assert [m["content"] for m in X.messages(target, "t", "a")] == ["do it\nmind a", "one", '{"a": 1}', "t"]
    assert [m["content"] for m in X.messages(target, "t", "b")] == ["do it", "t"]
    assert [m["role"] for m in X.messages(target, "t")] == ["system", "user", "assistant", "user"]
    assert X.extractor_for(None, False, 1, 2) == ("double", 1) and X.extractor_for("k", True, 1, 2) == ("single-shot", 2)


def test_extraction_keeps_failures_as_rows(spark):
    texts = spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string")
    got = {r.item_id: r for r in X.single_shot(texts, X.Target(("",)), lambda t, g: {"n": len(t)}, attempts=2).collect()}
    assert got[1].fields == '{"n": 1}' and got[1].attempts == 1 and got[2].fields is None and got[2].error.startswith("TypeError") and got[2].attempts == 2


def test_last_object():
    assert J._last_object('a {"x": "}"} {"y": {"z": "\\"{"}} tail {') == '{"y": {"z": "\\"{"}}'
    assert J._last_object("none } here") is None and J._last_object(None) is None
