"""Connected components for tables of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import lookup_join


def min_label(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` links to ``(node, label)``, the smallest node of each component.

    Each round a node takes the smallest label of its neighbours (combined
    before the shuffle) and then the label of that label; rounds follow the
    logarithm of the longest chain.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a != b")
    both = scratch.save(links.union(links.select("b", "a")).distinct())
    labels = scratch.save(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        seen = lookup_join(both, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("via"))
        ahead = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = lookup_join(step, ahead, "via").select("node", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("label")).alias("moved"))
        jumped = scratch.save(jumped)
        done = not jumped.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = jumped
        if done:
            return labels.select("node", "label")
