"""What links connect: the smallest member of each group, by rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links(a, b)``: the smallest node it is connected with.

    Every node takes the smallest label among its own and its neighbours', then the label of that label,
    until no label changes. Labels fall along paths twice as far each round; minima are taken before
    the shuffle, so a node with very many links is no burden.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        onward = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(lower.join(onward, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = stepped.select("node", "root")
        if stepped.where("was <> root").isEmpty():
            return labels
