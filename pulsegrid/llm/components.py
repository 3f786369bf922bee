"""Connected components by repeated contraction, on Spark tables from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges(a, b)`` reaches, as ``(node, root)``.

    Each round points every node at its smallest neighbour and keeps the edges between what the
    ends point at; a path shrinks by half or more, so rounds grow with the logarithm of its
    length. Minima are combined before the shuffle, so a node with very many edges is no hot key.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("parent")))
        if labels is None:
            labels = stored(parents.withColumnRenamed("parent", "root"))
        else:
            step = parents.select(F.col("node").alias("root"), "parent")
            last, labels = labels, stored(labels.join(step, "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")))
            discard(last)
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        last, edges = edges, stored(edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
                                    .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        discard(last, parents)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(edges)
    return labels
