"""Lines of text files as a data source of Spark's, in batches and as a stream, with the place of each line; and a sink that writes files by name.

A file is read in ranges of bytes; a line belongs to the range that it begins in. Nobody counts a file's lines beforehand: a row has the line's number within its range, and numbered() adds what the ranges before hold. A stream takes lines once they are ended, so that one that is still being written waits for its rest.

Paths are those that pyarrow's file systems reach. The module is sent to the workers by value, as planning happens in a worker that knows no package but pyspark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES, BLOCK, BATCH_LINES, BATCH_BYTES = 64 << 20, 1 << 20, 10_000, 4 << 20
LINE_SCHEMA = "file string, range long, offset long, nth long, text string"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files of a folder, or the file itself, with their sizes; hidden ones don't count."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith(("_", ".")) and fnmatch(x.base_name, pattern))


@dataclass
class _Range(InputPartition):
    """Lines that begin in start..end of a file; none is read beyond limit."""

    file: str
    start: int
    end: int
    limit: int


def _ranges(file: str, start: int, end: int, size: int) -> list[_Range]:
    return [_Range(file, a, min(a + size, end), end) for a in range(start, end, size)]


def _lines(store: pyarrow.fs.FileSystem, r: _Range, whole: bool) -> Iterator[tuple[int, bytes]]:
    """Where lines begin, and what is in them. whole: the range's start is that of a line."""
    with store.open_input_file(r.file) as f:
        at = r.start if whole else r.start - 1
        f.seek(at)
        held, skipping = b"", not whole
        while True:
            block = f.read(min(BLOCK, r.limit - at - len(held)))
            held += block
            begin = 0
            while (end := held.find(b"\n", begin)) >= 0:
                if not skipping and at + begin >= r.end:
                    return
                if not skipping:
                    yield at + begin, held[begin:end]
                skipping, begin = False, end + 1
            at, held = at + begin, held[begin:]
            if at >= r.end:
                return
            if not block:
                if held and not skipping:
                    yield at, held
                return
            if skipping:  # a line of an earlier range that goes on
                at, held = at + len(held), b""


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.size = options["path"], options.get("pattern", "*"), int(options.get("range_bytes", RANGE_BYTES))

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = _store(self.path)
        rows: list[tuple[int, int, str]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([partition.file] * n), pa.array([partition.start] * n, pa.int64()), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
            return pa.RecordBatch.from_arrays(columns, names=["file", "range", "offset", "nth", "text"])

        for nth, (at, line) in enumerate(_lines(store, partition, partition.start == 0 or self.begins_lines(partition)), 1):
            rows.append((at, nth, line.decode("utf-8", "replace")))
            held += len(line)
            if len(rows) >= BATCH_LINES or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def begins_lines(self, partition: _Range) -> bool:
        return False


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return [r for file, size in _files(self.path, self.pattern) for r in _ranges(file, 0, size, self.size)]


class _Stream(_Reading, DataSourceStreamReader):
    """The offset says of each file up to where its ended lines have been read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, _ = _store(self.path)
        out = {}
        for file, size in _files(self.path, self.pattern):
            with store.open_input_file(file) as f:
                at = size
                while at > 0:  # back to the last line's end: a block or so
                    begin = max(0, at - (64 << 10))
                    f.seek(begin)
                    end = f.read(at - begin).rfind(b"\n")
                    at = begin
                    if end >= 0:
                        out[file] = begin + end + 1
                        break
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [r for file, upto in sorted(end.items()) for r in _ranges(file, start.get(file, 0), upto, self.size)]

    def begins_lines(self, partition: _Range) -> bool:
        """Whether the byte before is a line's end, as it is where an earlier batch ended."""
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.start - 1)
            return f.read(1) == b"\n"

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Named(WriterCommitMessage):
    n: int


class _NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.ending = options["path"], options.get("ending", "")
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Named:
        store, at = _store(self.path)
        n = 0
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                target = f"{at}/{quote(name or '', safe=' ')}{self.ending}"
                with store.open_output_stream(target + ".part") as f:
                    f.write((text or "").encode())
                store.move(target + ".part", target)
                n += 1
        return _Named(n)


class Lines(DataSource):
    """format("attestra_lines"): option path, a folder or a file; pattern of file names; range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "attestra_lines"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(self.options)


class NamedFiles(DataSource):
    """format("attestra_files"): rows of name and text become files of these names (percent-encoded) and of option ending, in the folder of option path. A file comes into being as a whole; one that is there is replaced, so that a task that runs again does no harm."""

    @classmethod
    def name(cls) -> str:
        return "attestra_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> _NamedWriter:
        return _NamedWriter(self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    for source in (Lines, NamedFiles):
        spark.dataSource.register(source)
    return spark


def lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each line of the files in a folder, or of a file: file, range (where the bytes that its task reads begin), offset (where the line begins), nth (its number in the range, from 1) and text. Blank lines are lines."""
    return _registered(spark).read.format("attestra_lines").option("pattern", pattern).option("range_bytes", range_bytes).load(path)


def line_stream(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same as a stream over files that grow and come anew."""
    return _registered(spark).readStream.format("attestra_lines").option("pattern", pattern).option("range_bytes", range_bytes).load(path)


def numbered(found: DataFrame) -> DataFrame:
    """lines() with line, the number in the file, from 1. A row for each range is what meets in a window by file."""
    counts = found.groupBy("file", "range").agg(F.max("nth").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("file").alias("file__"), F.col("range").alias("range__"), before.alias("before__"))
    return found.join(starts, (F.col("file") == F.col("file__")) & (F.col("range") == F.col("range__"))).withColumn("line", F.col("before__") + F.col("nth")).drop("file__", "range__", "before__")


def files_written(rows: DataFrame, path: str, ending: str = "") -> None:
    """rows of name and text as files."""
    _registered(rows.sparkSession)
    rows.select("name", "text").write.format("attestra_files").option("ending", ending).mode("append").save(path)
