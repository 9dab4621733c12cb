"""Connected components of an edge table, by hooking to the smallest neighbour and halving the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import settled


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: bigint); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. Every round
    is written to the checkpoint folder, so a lost executor costs one round at most. Only the number of changed
    labels reaches the driver. An empty edge table gives an empty result.
    """
    # Where a node has several smaller neighbours, these and the node are linked to the smallest of them instead:
    # the components stay, and a dense group keeps about one edge for each node.
    upper, lower = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    down = edges.select(upper, lower).where("a <> b").distinct()
    least = down.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    fewer = least.select("a", F.col("least").alias("b")).union(least.select("b", "least").where("b <> least")).distinct()
    both = settled(fewer.union(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        above = labels.select(F.col("node").alias("lower"), F.col("label").alias("up"))
        moved = settled(
            hooked.join(above, "lower", "left").select(
                "node", F.least("lower", "up").alias("lower"), (F.col("label") != F.least("lower", "up")).alias("changed")
            )
        )
        labels = moved.select("node", F.col("lower").alias("label"))
        if not moved.where("changed").limit(1).count():
            return labels.withColumnRenamed("label", "component")
