"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes in links (a, b); each round takes the least label near by and jumps along labels, until none changes.

    Repeated links and links of a node with itself change nothing; an empty table gives an empty result; a link with a null is ignored. links is read in each round.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).where("a != b")
    # written, so that Spark may split the join of a node with very many links
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        after = written(least.join(jump, F.col("new") == F.col("at")).select("node", "old", F.least("new", "beyond").alias("component")))
        if after.where("old != component").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
