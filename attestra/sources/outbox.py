"""The queue's storage: an append-only log of whole rows, and its current state as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.queue import STATUSES, latest
from attestra.sources.folders import Files, written
from attestra.sources.versions import Parts, Versions

SCHEMA = "id string, version bigint, seq bigint, status string, idempotency_key string, attempts int, next_attempt_at timestamp, enqueued_at timestamp, last_error string, duration_ms bigint, transcript string, extracted string, source_id string, deleted boolean"


def problems(rows: DataFrame) -> DataFrame:
    """rows with problem: what makes a row unfit for the log, or null."""
    c = F.col
    told = (
        F.when(c("id").isNull(), "no id").when(c("seq").isNull() | (c("seq") < 0), "bad seq").when(~c("status").isin(*STATUSES) | c("status").isNull(), "unknown status")
        .when(c("attempts") < 0, "negative attempts").when(c("duration_ms") < 0, "negative duration").when((c("status") == "recording") & c("source_id").isNull(), "recording without a source")
    )
    return rows.withColumn("problem", told)


class Outbox:
    """path: a folder that driver and executors share. Rows are appended, never changed; versions order those of an id. Each append is a version of the log itself, and is there as a whole or not at all. Parquet that lies in the folder from before counts as the log's beginning."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path, Versions(spark, path)

    def version(self) -> int:
        """The log's version, which an append can be made from; -1: nothing was appended."""
        return self.versions.last()

    def append(self, rows: DataFrame, base: int | None = None) -> int:
        """Rows by name; columns that are missing are null. A row that breaks a rule fails the write. With base, the version that the rows were made from, an append after another's is refused (VersionConflict): read again and make them anew."""
        schema = self.spark.createDataFrame([], SCHEMA).schema
        whole = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        checked = problems(whole)
        guard = F.when(F.col("problem").isNotNull() & ~F.coalesce("deleted", F.lit(False)), F.raise_error(F.concat_ws(": ", "id", "problem")).cast("bigint")).otherwise(F.col("version"))
        (folders,) = self.versions.write(checked.withColumn("version", guard).drop("problem")).values()
        return self.versions.change(lambda parts: parts | {"log": [*parts.get("log", []), *folders]}, base)

    def compact(self) -> int:
        """All appends in one folder: for a log of many small ones."""

        def change(parts: Parts) -> Parts:
            (folders,) = self.versions.write(self.versions.read(parts["log"], SCHEMA)).values() if parts.get("log") else ([],)
            return parts | {"log": folders}

        return self.versions.change(change)

    def log(self, version: int | None = None) -> DataFrame:
        """All rows, or those of a version."""
        folders = self.versions.parts(version).get("log", [])
        old = [x for x in Files(self.spark).names(self.path) if x.endswith(".parquet")]
        appended = self.versions.read(folders, SCHEMA) if folders else self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).unionByName(appended) if old else appended

    def items(self, version: int | None = None) -> DataFrame:
        return latest(self.log(version))

    def remove(self, ids: DataFrame, version: int) -> int:
        """Tombstones for ids that are there; their number."""
        gone = written(self.items().join(ids.select("id"), "id", "left_semi").select("id", "seq").withColumn("version", F.lit(version)).withColumn("deleted", F.lit(True)))
        self.append(gone)
        return gone.count()

    def watch(self) -> DataFrame:
        """The log as a stream of rows as they are appended. It sees an append's files, whether or not its commit was refused: fold by version, or read log() where that matters."""
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/_parts/*")

    def drop(self) -> None:
        Files(self.spark).delete(self.path)


def written_once(writes: DataFrame, done: DataFrame) -> DataFrame:
    """Writes whose idempotency key has not been written before, one for each key: what a sink may send."""
    return writes.dropDuplicates(["idempotency_key"]).join(done.select("idempotency_key"), "idempotency_key", "left_anti")
