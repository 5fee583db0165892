"""Choice between engines: capabilities, hedged attempts, and cached answers.

capabilities: request, engine, ord, status (ready, needs-download or unavailable), reason; attempts: request, engine (primary or hedge), started_ms, finished_ms, ok, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import hedge_delay
from attestra.operators.queue import permanently_unavailable


def first_ready(capabilities: DataFrame) -> DataFrame:
    """By request the first ready engine, the engines before it that were skipped, and whether none can ever become ready."""
    ready = F.col("status") == "ready"
    return capabilities.groupBy("request").agg(
        F.min_by(F.when(ready, F.col("engine")), F.when(ready, F.col("ord"))).alias("engine"),
        F.min(F.when(ready, F.col("ord"))).alias("at"),
        F.array_sort(F.collect_list(F.when(~ready, F.struct("ord", "engine")))).alias("others"),
        F.bool_and((F.col("status") == "unavailable") & permanently_unavailable(F.col("reason"))).alias("never"),
    ).select("request", "engine", F.transform(F.filter("others", lambda x: F.col("at").isNull() | (x["ord"] < F.col("at"))), lambda x: x["engine"]).alias("skipped"), "never")


def best_capability(capabilities: DataFrame) -> DataFrame:
    """By request the status of the first ready engine, else of the first that needs a download, else of the first."""
    rank = F.when(F.col("status") == "ready", 0).when(F.col("status") == "needs-download", 1).otherwise(2)
    return capabilities.groupBy("request").agg(F.min_by(F.struct("engine", "status"), F.struct(rank, "ord")).alias("best")).select("request", "best.*")


def raced(attempts: DataFrame, predicted: Column, budget_ms: float) -> DataFrame:
    """By request who answered, after how long, or with which error, when a hedge starts once the primary has taken too long.

    attempts: request, primary_ready, primary_ms, primary_ok, primary_unavailable, hedge_ms, hedge_ok. A primary that fails before the delay as unavailable hands over at once; any other early error ends the request; if both fail, the primary's error counts.
    """
    delay = hedge_delay(predicted, budget_ms)
    early = F.col("primary_ms") <= F.col("delay")
    begun = F.when(~F.col("primary_ready"), 0.0).when(early & F.col("primary_unavailable"), F.col("primary_ms")).otherwise(F.col("delay"))
    hedge_end = F.col("begun") + F.col("hedge_ms")
    alone = F.col("primary_ready") & early & (F.col("primary_ok") | ~F.col("primary_unavailable"))
    primary = F.col("primary_ready") & F.col("primary_ok")
    winner = (
        F.when(alone & F.col("primary_ok"), "primary").when(alone, None)
        .when(primary & (~F.col("hedge_ok") | (F.col("primary_ms") <= hedge_end)), "primary").when(F.col("hedge_ok"), "hedge")
    )
    took = F.when(F.col("winner") == "primary", F.col("primary_ms")).when(F.col("winner") == "hedge", hedge_end)
    error = F.when(F.col("winner").isNull(), F.when(F.col("primary_ready"), "primary-failed").otherwise("hedge-failed"))
    out = attempts.withColumn("delay", delay).withColumn("begun", begun).withColumn("hedged", ~alone).withColumn("winner", winner)
    return out.withColumn("took_ms", took).withColumn("error", error).drop("begun")


def cached(lookups: DataFrame, answers: DataFrame, ttl_ms: int) -> DataFrame:
    """lookups (engine, at_ms) with the latest answer (engine, at_ms, status, reason) that still held then; a permanent one holds for ever.

    Both sides meet in one ordered sequence of each engine, so that no pairs are made.
    """
    from pyspark.sql.window import Window

    both = answers.select("engine", "at_ms", F.struct("at_ms", "status", "reason").alias("answer"), F.lit(0).alias("side")).unionByName(
        lookups.select("engine", "at_ms", F.lit(None).cast("struct<at_ms:bigint,status:string,reason:string>").alias("answer"), F.lit(1).alias("side"))
    )
    w = Window.partitionBy("engine").orderBy("at_ms", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("last", F.last("answer", ignorenulls=True).over(w)).where("side = 1")
    holds = permanently_unavailable(F.col("last.reason")) | (F.col("at_ms") - F.col("last.at_ms") < ttl_ms)
    return last.select("engine", "at_ms", F.when(holds, F.col("last.status")).alias("status"))
