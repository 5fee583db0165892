"""The queue's writes as rows of an append-only log, and the log folded to its current items.

log: id, version (grows with each write to an id), deleted, unset (names of fields that become null) and the fields; a field that is null and not in unset stays as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.queue import STATUSES, listed, merged_chunks, with_seq
from attestra.sources.folders import written


def folded(log: DataFrame, fields: list[str]) -> DataFrame:
    """The items as all writes leave them: of each field the last value that was set or unset since the item's last deletion; items whose last write deletes them are gone, and one that is written again begins anew. One aggregate with a map-side combine. Of writes of one id and version the order is open; a deletion's own fields don't count."""
    unset = F.coalesce("unset", F.expr("CAST(array() AS array<string>)"))
    gone = F.coalesce("deleted", F.lit(False))
    said = lambda c: F.when(~gone & (F.col(c).isNotNull() | F.array_contains(unset, c)), F.col("version"))
    last = log.groupBy("id").agg(*(F.struct(F.max_by(c, said(c)).alias("v"), F.max(said(c)).alias("at")).alias(c) for c in fields), F.max("version").alias("last__"), F.max(F.when(gone, F.col("version"))).alias("gone__"))
    since = lambda at: F.col("gone__").isNull() | (at > F.col("gone__"))
    return last.where(since(F.col("last__"))).select("id", *(F.when(since(F.col(c)["at"]), F.col(c)["v"]).alias(c) for c in fields))


def row_problem() -> Column:
    """What makes a whole item unfit, or null."""
    c = F.col
    return (
        F.when(c("id").isNull(), "no id").when(c("seq").isNull() | (c("seq") < 0), "bad seq").when(c("status").isNull() | ~c("status").isin(*STATUSES), "unknown status")
        .when(c("attempts").isNull() | (c("attempts") < 0), "bad attempts").when(c("duration_ms") < 0, "bad duration")
    )


def patched(items: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """items after patches (id, unset and the fields, at most one row for an id), each checked as a whole row: problem says why a patch is refused, and its item stays as it was. A patch of an id that isn't there is a row with the problem 'no item'."""
    new = patches.select("id", F.lit(True).alias("patch__"), F.coalesce("unset", F.expr("CAST(array() AS array<string>)")).alias("unset__"), *(F.col(c).alias(f"{c}__") for c in fields))
    both = items.withColumn("there__", F.lit(True)).join(new, "id", "full")
    after = {c: F.when(F.col(f"{c}__").isNotNull(), F.col(f"{c}__")).when(F.array_contains("unset__", c), None).otherwise(F.col(c)) for c in fields}
    rest = [c for c in items.columns if c != "id" and c not in fields]
    whole = both.select("id", "there__", "patch__", *rest, *(F.struct(F.col(c).alias("was"), after[c].alias("now")).alias(c) for c in fields))
    checked = whole.select("id", *rest, "there__", "patch__", *fields, *(F.col(c)["now"].alias(f"{c}__") for c in fields))
    as_row = checked.select("id", *rest, "there__", "patch__", *(F.col(c)["was"].alias(f"{c}__") for c in fields), *(F.col(f"{c}__").alias(c) for c in fields))
    problem = F.when(F.col("there__").isNull(), "no item").when(F.col("patch__").isNotNull(), row_problem())
    return as_row.withColumn("problem", problem).select("id", *rest, *(F.when(F.col("problem").isNull(), F.col(c)).otherwise(F.col(f"{c}__")).alias(c) for c in fields), "problem")


def _inserted(items: DataFrame, new: DataFrame, order: str, status: str, now: Column, key: Column) -> DataFrame:
    numbered = with_seq(items, new, order)
    return numbered.select("*", F.lit(status).alias("status"), key.alias("idempotency_key"), F.lit(0).alias("attempts"), now.alias("next_attempt_at"), now.alias("enqueued_at"))


def enqueued(items: DataFrame, recordings: DataFrame, order: str, now: Column, key: Column | None = None) -> DataFrame:
    """New queued items, audio and all in the same rows, from recordings (id, audio and others): numbered onwards from the highest seq, each with a fresh idempotency key."""
    return _inserted(items, recordings, order, "queued", now, F.expr("uuid()") if key is None else key)


def begun(items: DataFrame, captures: DataFrame, order: str, now: Column, key: Column | None = None) -> DataFrame:
    """New items that are being recorded, from captures (id, source_id and others)."""
    return _inserted(items, captures, order, "recording", now, F.expr("uuid()") if key is None else key)


def with_chunk(items: DataFrame, chunks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (id, name, bytes) and the new ones; a name that is there already is replaced. Second: new chunks of items that aren't there."""
    known = new.join(items.select("id"), "id", "left_semi")
    kept = chunks.join(known.select("id", "name"), ["id", "name"], "left_anti")
    return kept.unionByName(known), new.join(items.select("id"), "id", "left_anti")


def committed(items: DataFrame, chunks: DataFrame, audio: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What commits (id, audio, duration_ms; one for an id) of recordings leave: items, chunks and audio (id, bytes).

    Only an item that is being recorded is committed: its audio is stored in place of any other, it is queued with its length, and its chunks go. Others stay, and problem says what they are; a commit of an id that isn't there is a row of items with the problem 'no item', and nothing is stored for it.
    """
    said = commits.select("id", F.col("duration_ms").alias("length__"), F.col("audio").alias("audio__"), F.lit(True).alias("commit__"))
    both = items.withColumn("there__", F.lit(True)).join(said, "id", "full")
    done = F.col("commit__").isNotNull() & F.coalesce(F.col("status") == "recording", F.lit(False))
    problem = F.when(F.col("there__").isNull(), "no item").when(F.col("commit__").isNotNull() & ~done, F.concat(F.coalesce("status", F.lit("?")), F.lit(", not recording")))
    changed = {"status": F.when(done, F.lit("queued")).otherwise(F.col("status")), "duration_ms": F.when(done, F.col("length__")).otherwise(F.col("duration_ms"))}
    after = both.select(*(changed.get(c, F.col(c)).alias(c) for c in items.columns), problem.alias("problem"))
    stored = both.where(done).select("id", F.col("audio__").alias("bytes"))
    return after, chunks.join(stored.select("id"), "id", "left_anti"), without_audio(audio, stored).unionByName(stored)


def audio_of(audio: DataFrame, ids: DataFrame) -> DataFrame:
    """bytes by id of those asked for; an id without audio has none."""
    return ids.select("id").join(audio.select("id", "bytes"), "id", "left")


def without_audio(audio: DataFrame, ids: DataFrame) -> DataFrame:
    """audio without that of ids: their items stay, and are no longer audio_ready."""
    return audio.join(ids.select("id"), "id", "left_anti")


def cleared(items: DataFrame, statuses: list[str] | str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """items without those that a listing selects, and the ids that went."""
    gone = listed(items, statuses, limit).select("id")
    return items.join(gone, "id", "left_anti"), gone


#: What is said of a recording that can't be recovered, and of one that was.
NO_SOURCE, NO_AUDIO, SUCCESSOR = "unrecoverable: no capture.sourceId", "unrecoverable: cannot decode audio", "recovered as "
#: Columns that belong to an item's way through the queue; all others belong to its recording.
OF_THE_QUEUE = ("id", "seq", "version", "deleted", "status", "idempotency_key", "attempts", "next_attempt_at", "enqueued_at", "last_error", "transcript", "extracted", "source_id", "outcome", "audio", "duration_ms")


def recovered(items: DataFrame, chunks: DataFrame, decode: Callable[[Column], Column], order: str, now: Column, new_id: Callable[[Column], Column] | None = None, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of recordings that a crash cut short: (changes to them, new items).

    decode gives the duration of audio bytes, or null where they can't be read. The whole of an item's chunks is tried, then all but the last. Where either can be read, a new queued item takes the place of the old one, made as enqueued() makes any other: with that audio and its length, the recording's own columns (all that aren't the queue's), a seq, a key and times of its own, no attempts and no source. The old one is dead and names it. Else the old one is dead and lost, as is an item without a source. key: an expression over id, the new one.
    """
    broken = items.where("status = 'recording'")
    whole = merged_chunks(chunks).select("id", F.col("bytes").alias("whole__"))
    most = merged_chunks(chunks, without_last=True).select("id", F.col("bytes").alias("most__"))
    tried = broken.join(whole, "id", "left").join(most, "id", "left").withColumn("whole_ms__", decode(F.col("whole__"))).withColumn("most_ms__", decode(F.col("most__")))
    length = F.coalesce("whole_ms__", "most_ms__")
    audio = F.when(F.col("whole_ms__").isNotNull(), F.col("whole__")).otherwise(F.col("most__"))
    fresh = F.expr("uuid()") if new_id is None else new_id(F.col("id"))
    # written, as an item and the word of it must name the same new id
    judged = written(tried.withColumn("new_id__", F.when(F.col("source_id").isNotNull() & length.isNotNull(), fresh)))
    error = F.when(F.col("source_id").isNull(), NO_SOURCE).when(length.isNull(), NO_AUDIO).otherwise(F.concat(F.lit(SUCCESSOR), F.col("new_id__")))
    own = [c for c in items.columns if c not in OF_THE_QUEUE]
    recordings = judged.where("new_id__ IS NOT NULL").select(F.col("new_id__").alias("id"), F.col(order).alias("order__"), length.alias("duration_ms"), audio.alias("audio"), *own)
    return judged.select("id", F.lit("dead").alias("status"), error.alias("last_error")), enqueued(items, recordings, "order__", now, key).drop("order__")


def write_problem(values: Column, fields: list[str], context: Column, needed: list[str]) -> Column:
    """Why a write step must not write, or null: a context without what is needed can't be repaired, nor can values of unknown names. Both are maps."""
    lacking = F.array_except(F.array(*map(F.lit, needed)), F.coalesce(F.map_keys(F.map_filter(context, lambda _, v: v.isNotNull())), F.expr("CAST(array() AS array<string>)")))
    odd = F.array_except(F.coalesce(F.map_keys(values), F.expr("CAST(array() AS array<string>)")), F.array(*map(F.lit, fields)))
    return F.when(F.size(lacking) > 0, F.concat(F.lit("context lacks "), F.array_join(lacking, ", "))).when(values.isNull() | (F.size(values) == 0), "nothing to write").when(F.size(odd) > 0, F.concat(F.lit("unknown fields "), F.array_join(odd, ", ")))


def drained(items: DataFrame, now: Column, outcome: str, by: str) -> DataFrame:
    """The steps that one drain of each queue (by) takes: its active items by seq, one after the other, up to the first that isn't due or fails for now. A queue that is being recorded to takes none. outcome: ok, transient or terminal, of the step if it runs."""
    from pyspark.sql.window import Window

    queues = items.groupBy(by).agg(F.bool_or(F.col("status") == "recording").alias("blocked__"))
    w = Window.partitionBy(by).orderBy("seq")
    active = items.where(F.col("status").isin("queued", "transcribing", "extracting", "writing", "failed")).join(queues, by).where("NOT blocked__")
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    stops = F.max((~due | (F.col(outcome) == "transient")).cast("int"))
    before = F.coalesce(stops.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return active.withColumn("stopped__", before).withColumn("due__", due).where("stopped__ = 0 AND due__").drop("stopped__", "due__", "blocked__")


def timed_out(started_at: Column, now: Column, limit_s: int = 900) -> Column:
    """Whether a step has run for longer than it may; that is a failure like any other."""
    return F.coalesce(F.timestamp_diff("SECOND", started_at, now) > limit_s, F.lit(False))
