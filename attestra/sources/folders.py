"""Folders that driver and executors share, and the small files in them."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), under a local temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{purpose}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a folder of its own: what is read from it stays the same when executors are lost."""
    path = shared_folder(df.sparkSession, f"attestra/{df.sparkSession.sparkContext.applicationId}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and folders of any store that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, sorted; none if it isn't there."""
        at, fs = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """The text as a file that comes into being as a whole, or not at all if one of that name is there: False then. Renaming decides, so the store must rename in one step (HDFS does)."""
        at, fs = self._at(path)
        part, _ = self._at(f"{at.getParent()}/.{at.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf)
        nothing = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(part, at, nothing)
        except Py4JJavaError as refused:
            fs.delete(part, False)
            if fs.exists(at):
                return False
            raise refused
        return True

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)
