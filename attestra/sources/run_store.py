"""Runs and their history as snapshots: one current run for each label, and every run ever saved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.sources.versions import Parts, Versions


class RunStore:
    """root: a folder that driver and executors share. runs: label, captured_at and others. Every change is one version: saved runs become current and part of their histories at once or not at all. base: the version that a change was made from; if another came since, it is refused (VersionConflict)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def save(self, runs: DataFrame, base: int | None = None) -> int:
        """The labels' current runs are replaced, their histories get one more. runs is evaluated once."""
        new = self.versions.write(runs, "label")

        def change(parts: Parts) -> Parts:
            for label, folders in new.items():
                parts = parts | {f"current/{label}": folders, f"history/{label}": [*parts.get(f"history/{label}", []), *folders]}
            return parts

        return self.versions.change(change, base)

    def _read(self, kind: str, label: str | None) -> DataFrame:
        parts = self.versions.parts()
        names = [f"{kind}/{label}"] if label is not None else sorted(x for x in parts if x.startswith(f"{kind}/"))
        folders = [x for name in names for x in parts.get(name, [])]
        if folders:
            return self.versions.read(folders)
        some = [x for found in parts.values() for x in found]
        return self.versions.read(some).limit(0) if some else self.spark.createDataFrame([], "label string, captured_at timestamp")

    def current(self, label: str | None = None) -> DataFrame:
        return self._read("current", label)

    def history(self, label: str | None = None) -> DataFrame:
        return self._read("history", label)

    def labels(self) -> DataFrame:
        """Labels that have a current run: the manifest knows them."""
        return self.spark.createDataFrame([(x.removeprefix("current/"),) for x in sorted(self.versions.parts()) if x.startswith("current/")], "label string")

    def _rewrite(self, label: str, narrowed: Callable[[DataFrame], DataFrame], base: int | None) -> int:
        """Only the label's history is written anew; a history that another commit has changed meanwhile is narrowed again."""

        def change(parts: Parts) -> Parts:
            name = f"history/{label}"
            if name not in parts:
                return parts
            (folders,) = self.versions.write(narrowed(self.versions.read(parts[name]))).values()
            return parts | {name: folders}

        return self.versions.change(change, base)

    def delete_entry(self, label: str, captured_at: object, base: int | None = None) -> int:
        return self._rewrite(label, lambda rows: rows.where(~F.col("captured_at").eqNullSafe(F.lit(captured_at))), base)

    def prune(self, label: str, keep: int, base: int | None = None) -> int:
        """Only the last `keep` entries stay; none if that is not over 0."""
        w = Window.partitionBy("label").orderBy(F.desc("captured_at"))
        return self._rewrite(label, lambda rows: rows.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= keep).drop("nth__"), base)

    def delete_run(self, label: str, base: int | None = None) -> int:
        return self.versions.change(lambda parts: {k: v for k, v in parts.items() if k not in (f"current/{label}", f"history/{label}")}, base)


def newest(*replicas: DataFrame) -> DataFrame:
    """Of several copies of markers (key, seen_at, ...) the one seen last; on a tie the first copy's."""
    both = replicas[0].withColumn("copy", F.lit(0))
    for k, other in enumerate(replicas[1:], 1):
        both = both.unionByName(other.withColumn("copy", F.lit(-k)))
    others = [c for c in replicas[0].columns if c != "key"]
    return both.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("seen_at", "copy")).alias("m")).select("key", "m.*")


def eviction(markers: DataFrame, items: DataFrame) -> DataFrame:
    """What became of a device's queue: evicted if it held rows when last seen and holds none now."""
    n = items.groupBy(F.col("device").alias("key")).agg(F.count("*").alias("now"))
    verdict = F.when(F.col("was").isNull(), "first-visit").when((F.col("was") > 0) & (F.coalesce("now", F.lit(0)) == 0), "evicted").otherwise("intact")
    return markers.select("key", F.col("n").alias("was")).join(n, "key", "full").select("key", verdict.alias("verdict"))
