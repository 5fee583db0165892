"""Regions of speech in ordered frames, and of windows over samples.

frames: stream, frame (0, 1, ... within a stream), p. regions: stream, start, end (half open, in frames). Each stream is a sequence of its own; streams are spread over the cluster, and every step but cut() is made of window and array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions.numbers import frames as in_frames
from attestra.functions.numbers import sample_of

#: Thresholds, and durations in milliseconds.
ONSET, LEAVE, MIN_SPEECH, MIN_SILENCE, PAD, MAX_CHUNK = 0.5, 0.35, 250, 100, 200, 30_000


def _in_order(by: str = "frame"):
    return Window.partitionBy("stream").orderBy(by)


def binarized(frames: DataFrame, onset: float = ONSET, leave: float = LEAVE) -> DataFrame:
    """Regions that begin at p >= onset and end before p < leave; leave may not be over onset."""
    if leave > onset:
        raise ValueError("leave must not be over onset")
    said = F.when(F.col("p") >= onset, 1).when(F.col("p") < leave, 0)
    held = F.last(said, ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    speech = frames.withColumn("held", held).where("held = 1")
    island = F.col("frame") - F.row_number().over(_in_order())
    return speech.withColumn("island", island).groupBy("stream", "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("island")


def bridged(regions: DataFrame, min_silence: int) -> DataFrame:
    """Regions with gaps shorter than min_silence closed."""
    apart = F.coalesce((F.col("start") - F.lag("end").over(_in_order("start")) >= min_silence).cast("int"), F.lit(1))
    island = F.sum("apart").over(_in_order("start").rowsBetween(Window.unboundedPreceding, 0))
    return regions.withColumn("apart", apart).withColumn("island", island).groupBy("stream", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def long_enough(regions: DataFrame, min_speech: int) -> DataFrame:
    return regions.where(F.col("end") - F.col("start") >= min_speech)


def padded(regions: DataFrame, pad: int, lengths: DataFrame) -> DataFrame:
    """Regions widened on both sides within their stream (lengths: stream, length); neighbours that would collide meet in the middle of their gap."""
    w = _in_order("start")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    start, end = F.greatest(F.lit(0), F.col("start") - pad), F.least(F.col("length"), F.col("end") + pad)
    joined = regions.join(lengths, "stream")
    left = F.when(before.isNotNull() & (F.least(F.col("length"), before + pad) > start), F.floor((before + F.col("start")) / 2)).otherwise(start)
    right = F.when(after.isNotNull() & (end > F.greatest(F.lit(0), after - pad)), F.floor((F.col("end") + after) / 2)).otherwise(end)
    return joined.select("stream", left.cast("long").alias("start"), right.cast("long").alias("end"))


def _parted(lists: DataFrame, part: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """stream, start and end of what a function of a row's list gives; rows go to Python in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [part(x) for x in batch.column("list").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            spans = np.array([s for x in found for s in x], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("stream").take(at), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["stream", "start", "end"])

    return lists.select("stream", "list").mapInArrow(run, f"stream {lists.schema['stream'].dataType.simpleString()}, start long, end long")


def merged(regions: DataFrame, max_span: int) -> DataFrame:
    """Neighbours joined from the left for as long as they span at most max_span: one walk over each stream's regions."""

    def walk(found: list[dict]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for x in found:
            if out and x["end"] - out[-1][0] <= max_span:
                out[-1][1] = x["end"]
            else:
                out.append([x["start"], x["end"]])
        return [(x, y) for x, y in out]

    own = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return _parted(regions.groupBy("stream").agg(F.array_sort(F.collect_list(own)).alias("list")), walk)


def _cut(p: list[float], start: int, max_span: int) -> list[tuple[int, int]]:
    out, todo = [], [(0, len(p))]
    while todo:
        a, b = todo.pop()
        span = b - a
        if span <= max_span:
            out.append((start + a, start + b))
            continue
        low, high = a + span // 4, a + -(-3 * span // 4)
        at = min(range(low, high), key=lambda k: (p[k], k))
        todo += [(a, at), (at, b)]
    return sorted(out)


def cut(regions: DataFrame, frames: DataFrame, max_span: int) -> DataFrame:
    """Regions longer than max_span (4 at least) parted at the first quietest frame of their middle half, again and again. Regions of a stream don't overlap: the last one that began before a frame is carried along to it, so that only frames inside are kept."""
    if max_span < 4:
        raise ValueError("max_span must be 4 at least")
    long_ = regions.where(F.col("end") - F.col("start") > max_span)
    begins = long_.select("stream", F.col("start").cast("long").alias("frame"), F.lit(None).cast("double").alias("p"), F.struct("start", "end").alias("region"), F.lit(0).alias("ord"))
    every = frames.select("stream", F.col("frame").cast("long").alias("frame"), F.col("p").cast("double").alias("p"), F.lit(None).cast(begins.schema["region"].dataType).alias("region"), F.lit(1).alias("ord"))
    w = Window.partitionBy("stream").orderBy("frame", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = begins.unionByName(every).withColumn("region", F.last("region", ignorenulls=True).over(w)).where("ord = 1 AND frame < region.end")
    lists = inside.groupBy("stream", F.col("region.start").alias("start")).agg(F.array_sort(F.collect_list(F.struct("frame", "p"))).alias("list"))
    shorter = _parted(lists, lambda found: _cut([x["p"] for x in found], found[0]["frame"], max_span))
    return regions.where(F.col("end") - F.col("start") <= max_span).select("stream", "start", "end").unionByName(shorter)


def chunks(frames: DataFrame, rate: int, step: int, offset: int, samples: DataFrame, max_chunk_ms: int = MAX_CHUNK) -> DataFrame:
    """From frames to ranges of samples (stream, start, end), within each stream's samples (stream, n): all steps above in their order."""
    n = lambda ms: max(1, int(ms / 1000 * rate / step + 0.5))
    lengths = frames.groupBy("stream").agg((F.max("frame") + 1).alias("length"))
    found = long_enough(bridged(binarized(frames), n(MIN_SILENCE)), n(MIN_SPEECH))
    found = cut(merged(padded(found, n(PAD), lengths), n(max_chunk_ms)), frames, n(max_chunk_ms))
    within = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), sample_of(F.col(c), step, offset)))
    return found.join(samples, "stream").select("stream", within("start").alias("start"), within("end").alias("end"))


def overlapping_windows(lengths: DataFrame, window: int, hop: int) -> DataFrame:
    """Windows over n samples (stream, n), until one reaches the end."""
    last = F.when(F.col("n") <= window, 0).otherwise(F.ceil((F.col("n") - window) / hop))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: k * hop)
    spread = lengths.where("n > 0").select("stream", "n", F.explode(starts).alias("start"))
    return spread.select("stream", "start", F.least(F.col("n"), F.col("start") + window).alias("end"))


def fixed_pauses(lengths: DataFrame, interval: int) -> DataFrame:
    """The end of each full interval of n samples (stream, n), and of what is left."""
    ends = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / interval)), lambda k: F.least(k * interval, F.col("n")))
    return lengths.where("n > 0").select("stream", F.explode(ends).alias("end"))


def averaged(windows: DataFrame) -> DataFrame:
    """Where windows of frames (stream, frame, p) overlap, their mean."""
    return windows.groupBy("stream", "frame").agg(F.avg("p").alias("p"))


def loudness(samples: DataFrame, x: str = "x") -> DataFrame:
    """Root mean square by stream."""
    return samples.groupBy("stream").agg(F.coalesce(F.sqrt(F.avg(F.col(x) * F.col(x))), F.lit(0.0)).alias("rms"))


def byte_loudness(samples: DataFrame, x: str = "x") -> DataFrame:
    """Root mean square of unsigned bytes around 128, at most 1."""
    d = (F.col(x) - 128) / 128.0
    return samples.groupBy("stream").agg(F.least(F.lit(1.0), F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0))).alias("rms"))
