"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and Spark runs in one process (tests), a local temporary one; elsewhere that is an error, as executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that lost executors don't undo.

    The tables stay as long as results that are read from them may be asked for; they lie in a folder of the application, attestra/<application id>, which may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attestra/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def _others(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in ("doc_id", "text")]


def packed(documents: DataFrame) -> DataFrame:
    """doc_id, text (as a string) and rest__, all other columns as one and by their places: their names then clash with none of an operator's own."""
    rest = [named(c).alias(f"c{k}") for k, c in enumerate(_others(documents.columns))]
    return documents.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(F.lit(True).alias("some"), *rest).alias("rest__"))


def packed_column(columns: list[str], column: str) -> Column:
    """A column of packed(), of the documents' columns."""
    return F.col(column) if column in ("doc_id", "text") else F.col("rest__")[f"c{_others(columns).index(column)}"]


def unpacked(packed_documents: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns as they were before packed(), but for those that are replaced."""
    return packed_documents.select(*(replaced.get(c, packed_column(columns, c)).alias(c) for c in columns))


def row_names() -> Iterator[int]:
    """A number for each row that a task makes, unlike any of another task: by its partition and the place within. Only a table that is written once keeps them."""
    task = TaskContext.get()
    return itertools.count((task.partitionId() if task else 0) << 36)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Batches of documents that go to Python hold at most about `size` bytes, unless the session has a bound of its own: rows alone bound no memory, as texts may be long."""
    if spark.conf.get(_BATCH, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, str(size))
