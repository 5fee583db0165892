"""Commits of snapshots: two writers, and failures on the way."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from attestra.sources.folders import shared_folder
from attestra.sources.outbox import Outbox
from attestra.sources.run_store import RunStore
from attestra.sources.versions import VersionConflict, Versions


def runs(spark, *rows):
    return spark.createDataFrame([(label, datetime.datetime(2020, 1, day), n) for label, day, n in rows], "label string, captured_at timestamp, n long")


def seen(df):
    return sorted((r.label, r.captured_at.day, r.n) for r in df.collect())


def test_of_two_writers_one_is_refused(spark):
    box = Outbox(spark, shared_folder(spark, "outbox"))
    new = lambda i: spark.createDataFrame([(i, 1, 0, "queued")], "id string, version long, seq long, status string")
    box.append(new("a"))
    base, told = box.version(), []

    def write(name):
        try:
            told.append(box.append(new(name), base))
        except VersionConflict:
            told.append("refused")

    threads = [threading.Thread(target=write, args=(x,)) for x in "bc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, told)) == ["1", "refused"] and box.log().count() == 2
    box.append(new("d"))  # without a base an append is made whatever came before
    assert box.version() == 2 and box.log().count() == 3 and box.log(0).count() == 1
    box.compact()
    assert box.log().count() == 3 and len(box.versions.parts()["log"]) == 1


def test_a_failure_leaves_the_old_run(spark):
    store = RunStore(spark, shared_folder(spark, "runs"))
    assert store.current().isEmpty() and store.labels().isEmpty()
    store.save(runs(spark, ("a b/c", 1, 1), ("x", 1, 1)))
    bad = runs(spark, ("x", 2, 2)).withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.save(bad)
    # everything is written, the commit does not come: neither history nor current has it
    commit, store.versions.commit = store.versions.commit, lambda base, parts: (_ for _ in ()).throw(OSError("lost power"))
    with pytest.raises(OSError):
        store.save(runs(spark, ("x", 3, 3)))
    store.versions.commit = commit
    assert seen(store.current()) == seen(store.history()) == [("a b/c", 1, 1), ("x", 1, 1)]
    store.save(runs(spark, ("x", 4, 4)))
    assert seen(store.current()) == [("a b/c", 1, 1), ("x", 4, 4)] and seen(store.history("x")) == [("x", 1, 1), ("x", 4, 4)]
    assert store.versions.vacuum() >= 1
    assert seen(store.history()) == [("a b/c", 1, 1), ("x", 1, 1), ("x", 4, 4)]


def test_old_versions_can_be_read_and_stale_changes_are_refused(spark):
    store = RunStore(spark, shared_folder(spark, "runs"))
    first = store.save(runs(spark, *(("x", k, k) for k in range(1, 6))))
    store.prune("x", 2)
    assert seen(store.history("x")) == [("x", 4, 4), ("x", 5, 5)] and len(store.versions.parts(first)["history/x"]) == 1
    with pytest.raises(VersionConflict):
        store.delete_entry("x", datetime.datetime(2020, 1, 5), first)
    store.delete_entry("x", datetime.datetime(2020, 1, 5))
    store.prune("x", 0)
    assert store.history("x").isEmpty() and store.current("x").count() == 5
    store.delete_run("x")
    store.delete_run("unknown")
    store.prune("unknown", 1)
    assert store.labels().isEmpty() and store.current("x").isEmpty()


def test_many_writers_lose_nothing(spark):
    versions = Versions(spark, shared_folder(spark, "many"))

    def write(name):
        for k in range(5):
            versions.change(lambda parts, k=k: parts | {f"{name}{k}": []})

    threads = [threading.Thread(target=write, args=(x,)) for x in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert versions.last() == 19 and len(versions.parts()) == 20
