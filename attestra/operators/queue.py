"""A durable queue of recordings: states, what comes next, what is due, and summaries.

items: id, seq, status, attempts, next_attempt_at, duration_ms, transcript, extracted and others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions.numbers import jitter_delay
from attestra.sources.folders import written

#: Fixed values.
STATUSES = ("recording", "queued", "transcribing", "extracting", "awaiting-review", "writing", "failed", "done", "discarded", "dead")
ACTIVE = ("queued", "transcribing", "extracting", "writing", "failed")
FINISHED = ("done", "discarded", "dead")
PERMANENT = ("unsupported-platform", "too-slow")
MAX_ATTEMPTS = 8
#: Characters a second below which a transcript is implausible.
LEAST_RATE = 0.5


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def listed(items: DataFrame, statuses: list[str] | str | None = None, limit: int | None = None) -> DataFrame:
    """Items of those statuses by seq; with a limit, the first ones."""
    wanted = [statuses] if isinstance(statuses, str) else statuses
    out = items if wanted is None else items.where(F.col("status").isin(*wanted))
    out = out.orderBy("seq")
    return out if limit is None else out.limit(limit)


def latest(log: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The last row of each key in an append-only log; rows that say deleted end the key."""
    others = [c for c in log.columns if c not in (key, order)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("row"))
    out = last.select(key, "row.*")
    return out.where("NOT coalesce(deleted, false)").drop("deleted") if "deleted" in others else out


def next_step(transcript: Column, extracted: Column) -> Column:
    """By what is there, not by the status."""
    return F.when(transcript.isNull(), "transcribe").when(extracted.isNull(), "extract").otherwise("write")


def implausible(text: Column, duration_ms: Column) -> Column:
    """Too few characters for the recording's length; never where that isn't over 0."""
    return F.coalesce((duration_ms > 0) & (F.length(F.trim(text)) * 1000 / duration_ms < LEAST_RATE), F.lit(False))


def transient(http_status: Column, terminal: Column) -> Column:
    """Whether to try again: not after an error that is final, nor after 4xx but 408 and 429."""
    client = (http_status >= 400) & (http_status < 500) & ~http_status.isin(408, 429)
    return ~F.coalesce(terminal, F.lit(False)) & ~F.coalesce(client, F.lit(False))


def permanently_unavailable(reason: Column) -> Column:
    return F.coalesce(reason.isin(*PERMANENT), F.lit(False))


def head(items: DataFrame) -> DataFrame:
    """The active item of least seq, or no row."""
    return items.where(is_active(F.col("status"))).groupBy().agg(F.min_by(F.struct(*items.columns), "seq").alias("item")).where("item IS NOT NULL").select("item.*")


def due(items: DataFrame, now: Column) -> DataFrame:
    """The head, if it is due and nothing is being recorded; a head that isn't due holds back all others."""
    one = items.groupBy().agg(
        F.min_by(F.when(is_active(F.col("status")), F.struct(*items.columns)), F.when(is_active(F.col("status")), F.col("seq"))).alias("item"),
        F.bool_or(F.col("status") == "recording").alias("recording"),
    )
    ready = ~F.coalesce("recording", F.lit(False)) & F.col("item").isNotNull() & (F.col("item.next_attempt_at").isNull() | (F.col("item.next_attempt_at") <= now))
    return one.where(ready).select("item.*")


def with_seq(items: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new with seq: onwards from the highest in items, in the given order. Rows are numbered within ranges of the order; only a count for each range is gathered in one task."""
    top = items.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).scalar()
    return numbered(new, [order], "nth__").withColumn("seq", top + F.col("nth__")).drop("nth__")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, in an order that has no ties. Ranges of the order are numbered each for itself from what the ranges before hold; only a count for each range is gathered in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("range__", F.spark_partition_id())
    # written, so that rows are counted and numbered in the same ranges whatever executors are lost
    ranged = written(ranged)
    counts = ranged.groupBy("range__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("range__", F.coalesce(before, F.lit(0)).alias("before__"))
    within = ranged.withColumn("nth_in__", F.row_number().over(Window.partitionBy("range__").orderBy(*order)))
    return within.join(F.broadcast(starts), "range__").withColumn(name, F.col("before__") + F.col("nth_in__")).drop("range__", "before__", "nth_in__")


def with_audio(items: DataFrame, audio: DataFrame, chunks: DataFrame) -> DataFrame:
    """items with audio_ready and audio_bytes: the whole file's length, else what the chunks of a recording in progress sum up to, else 0."""
    whole = audio.select("id", F.length("bytes").cast("long").alias("whole"))
    parts = chunks.groupBy("id").agg(F.sum(F.length("bytes")).alias("parts"))
    size = F.when(F.col("whole").isNotNull(), F.col("whole")).when(F.col("status") == "recording", F.coalesce("parts", F.lit(0))).otherwise(0)
    joined = items.join(whole, "id", "left").join(parts, "id", "left")
    return joined.withColumn("audio_ready", F.col("whole").isNotNull()).withColumn("audio_bytes", size).drop("whole", "parts")


def merged_chunks(chunks: DataFrame, without_last: bool = False) -> DataFrame:
    """Chunks (id, name, bytes) of each id joined in the order of their names; without the last, ids of one chunk have none."""
    lists = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "bytes"))).alias("c"))
    if without_last:
        lists = lists.withColumn("c", F.when(F.size("c") > 1, F.slice("c", F.lit(1), F.size("c") - 1)))
    whole = F.aggregate("c", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    return lists.select("id", F.when(F.col("c").isNotNull(), whole).alias("bytes"))


def summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of pending, dead, synced and awaiting_review; what awaits review is pending too, what is discarded counts nowhere."""
    status = F.col("status")
    pending = is_active(status) | status.isin("recording", "awaiting-review")
    return items.groupBy(*(by or [])).agg(
        F.count_if(pending).alias("pending"), F.count_if(status == "dead").alias("dead"), F.count_if(status == "done").alias("synced"), F.count_if(status == "awaiting-review").alias("awaiting_review")
    )


def safety(work: DataFrame, persistence: Column, capture: Column) -> DataFrame:
    """Summaries with level and reason: what a person should know about the work on a device."""
    level = (
        F.when(F.col("dead") > 0, F.struct(F.lit("action-required").alias("level"), F.lit("failed-permanently").alias("reason")))
        .when(F.coalesce(capture == "stalled", F.lit(False)), F.struct(F.lit("at-risk").alias("level"), F.lit("capture-stalled").alias("reason")))
        .when((F.col("pending") == 0) & (F.col("synced") > 0), F.struct(F.lit("safe").alias("level"), F.lit("all-synced").alias("reason")))
        .when(F.col("pending") == 0, F.struct(F.lit("safe").alias("level"), F.lit("nothing-captured").alias("reason")))
        .when(F.coalesce(capture == "flushing", F.lit(False)), F.struct(F.lit("protected").alias("level"), F.lit("recording").alias("reason")))
        .when(~F.coalesce(persistence == "granted", F.lit(False)), F.struct(F.lit("at-risk").alias("level"), F.lit("not-persisted").alias("reason")))
        .otherwise(F.struct(F.lit("protected").alias("level"), F.lit("awaiting-sync").alias("reason")))
    )
    return work.withColumn("safety", level).select(*work.columns, "safety.*")


def after_failure(items: DataFrame, transient_: Column, now: Column, delay_ms: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """items whose step failed, as they are afterwards: dead if the error is final or it was the last attempt, else failed until a later time. delay_ms is that of the attempts before."""
    n = F.col("attempts") + 1
    gone = ~transient_ | (n >= most)
    wait = F.when(~gone, F.timestamp_add("MILLISECOND", delay_ms.cast("int"), now))
    return items.withColumn("status", F.when(gone, "dead").otherwise("failed")).withColumn("next_attempt_at", wait).withColumn("attempts", n)


@dataclass(frozen=True)
class Policy:
    """What a host may choose about failures: which are worth another try (of the error's HTTP status and whether it says it is final), how many tries there are, what time it is, and the jitter's random number (0 to 1) and window."""

    is_transient: Callable[[Column, Column], Column] = transient
    max_attempts: int = MAX_ATTEMPTS
    now: Callable[[], Column] = F.current_timestamp
    random: Callable[[], Column] = F.rand
    base_ms: float = 1000
    cap_ms: float = 60_000

    def failed(self, items: DataFrame, http_status: str, terminal: str) -> DataFrame:
        """items whose steps failed with errors (columns http_status and terminal), as the policy leaves them."""
        delay = jitter_delay(F.col("attempts"), self.base_ms, self.cap_ms, self.random())
        return after_failure(items, self.is_transient(F.col(http_status), F.col(terminal)), self.now(), delay, self.max_attempts)


def reopened(items: DataFrame) -> DataFrame:
    """Dead items with a transcript and extracted fields go back to review; others stay."""
    back = (F.col("status") == "dead") & F.col("transcript").isNotNull() & F.col("extracted").isNotNull()
    return items.withColumn("status", F.when(back, "awaiting-review").otherwise(F.col("status")))


def reviewed(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (id, outcome: accepted, edited or discarded) applied to items that await review; all others stay."""
    done = F.col("outcome").isNotNull() & (F.col("status") == "awaiting-review")
    status = F.when(done & (F.col("outcome") == "discarded"), "discarded").when(done, "writing").otherwise(F.col("status"))
    return items.join(outcomes, "id", "left").withColumn("attempts", F.when(done, 0).otherwise(F.col("attempts"))).withColumn("status", status).drop("outcome")


def edges(states: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows at which the value begins to be true, of each key's sequence; the first row is the base and is none."""
    w = Window.partitionBy(key).orderBy(order)
    return states.withColumn("before", F.lag(value).over(w)).where(F.col(value) & ~F.col("before")).drop("before")
