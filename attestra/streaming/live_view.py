"""A view that is kept up by changes.

A processor turns each item's new row into a retraction of its old one and the new one; what a micro-batch changes in each group is summed up and added to the view as a part of its own, so that what is written follows the groups that changed, not the view. A group's value is the sum over parts. A batch that runs twice is added once, as each part is named by its batch and the view's versions know it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.versions import Parts, Versions
from attestra.streaming.folds import Processor


def retractions(columns: dict[str, str]) -> Processor:
    """An item's rows (columns and their kinds) as changes: sign -1 with what no longer holds, 1 with what holds now. A row that changes nothing gives nothing; one whose column deleted is true only takes back."""

    def step(state: dict, event: dict) -> list[dict]:
        old, gone = state.get("row"), bool(event.get("deleted") or False)
        new = None if gone else {c: _plain(event[c]) for c in columns}
        state["row"] = new
        return [] if old == new else [{**row, "sign": sign} for row, sign in ((old, -1), (new, 1)) if row is not None]

    return Processor({"row": None}, step, ", ".join(f"{c} {kind}" for c, kind in columns.items()) + ", sign long", at_rest=lambda state: state["row"] is None)


def _plain(value: object) -> object:
    """A value as JSON keeps it: pandas' scalars are turned into Python's, and what is missing into None."""
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else value


class LiveView:
    """root: a folder that driver and executors share; groups: the columns that rows are grouped by; sums: columns that are added up for each group. The view has groups, n (rows) and the sums; groups without rows are not in it."""

    def __init__(self, spark: SparkSession, root: str, groups: list[str], sums: list[str], most_parts: int = 32):
        """most_parts: from so many parts on they are made one, so that reading stays cheap; it is the only time when the whole view is written."""
        self.spark, self.versions, self.groups, self.sums, self.most_parts = spark, Versions(spark, root), groups, sums, most_parts

    def _added(self, rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy(*self.groups).agg(F.expr(f"sum({n})").alias("n"), *(F.sum(c).alias(c) for c in self.sums))

    def add(self, changes: DataFrame, batch: str) -> None:
        """Changes (groups, sums and sign) of a batch."""
        if batch in self.versions.parts():
            return
        signed = changes.select(*self.groups, "sign", *((F.col(c) * F.col("sign")).alias(c) for c in self.sums))
        by_group = self._added(signed, "sign")
        changed = by_group.where(" OR ".join(f"coalesce({c}, 0) != 0" for c in ("n", *self.sums)))
        (folders,) = self.versions.write(changed).values()
        self.versions.change(lambda parts: parts | {batch: folders})
        if sum(map(len, self.versions.parts().values())) > self.most_parts:
            self.compact()

    def compact(self) -> None:
        """One part for all; the batches' names stay, so that none is added again."""

        def change(parts: Parts) -> Parts:
            (folders,) = self.versions.write(self._sum(parts)).values()
            return {name: [] for name in parts} | {"": folders}

        self.versions.change(change)

    def _sum(self, parts: Parts) -> DataFrame:
        return self._added(self.versions.read([x for folders in parts.values() for x in folders]), "n").where("n != 0")

    def read(self) -> DataFrame:
        """The view as it stands."""
        return self._sum(self.versions.parts())

    def start(self, changes: DataFrame, checkpoint: str):
        """A stream of changes, all that is there now, into the view."""

        def run(rows: DataFrame, epoch: int) -> None:
            rows = rows.persist()  # rows of one micro-batch
            try:
                self.add(rows, f"{self.spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{epoch}")
            finally:
                rows.unpersist()

        return changes.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
