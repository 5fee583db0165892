"""Health of the captures that are active: two streams joined by intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health_in_captures(captures: DataFrame, health: DataFrame, longest: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """What was said of health (device, at, health and others) while a capture (device, capture, begin, end) of its device was active: from its begin to before its end. Both streams may come `late`; no capture counts for longer than `longest`, so that the join forgets what can meet nothing any more."""
    c = captures.select(F.col("device").alias("device__"), "capture", "begin", "end").withWatermark("begin", late)
    h = health.withWatermark("at", late)
    active = F.expr(f"device = device__ AND at >= begin AND at < end AND at < begin + INTERVAL {longest}")
    return h.join(c, active).drop("device__")


def of_the_last_registered(joined: DataFrame, event: list[str]) -> DataFrame:
    """Of captures that were active at once the one that began last counts (of equal begin the greatest): one row for each event of health."""
    rest = [x for x in joined.columns if x not in event]
    return joined.groupBy(*event).agg(F.max_by(F.struct(*rest), F.struct("begin", "capture")).alias("r")).select(*event, "r.*")
