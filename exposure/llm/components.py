"""Connected components by contraction: every node goes to its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.scratch import saved


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges (a, b)``; the label is a node of the component.

    Each round takes every node to the smallest node among itself and its neighbours, and follows that step once more;
    edges within one node go. Stars end in a round, a path of n nodes in about log n."""
    edges = saved(edges.where("a <> b").select("a", "b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        step = saved(step)
        again = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = saved(step.join(again, "to", "left").select("a", F.coalesce("next", "to").alias("to")))
        on = step.select(F.col("a").alias("label"), "to")
        labels = saved(labels.join(on, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        left, right = step, step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b"))
        edges = saved(moved.where("a <> b").distinct())
    return labels
