"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``; the least node names a component.

    Each round a node takes the least label around it (union) and then the label
    of its label (path halving), until nothing changes. Labels and links stay in
    tables; the driver only learns whether a round changed anything.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    both = written(both.filter("a <> b").distinct())
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = written(labels.withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b")
        least = around.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        united = labels.join(least, "node").select(
            "node",
            F.col("component").alias("before"),
            F.least("component", "near").alias("component"),
        )
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = united.join(above, "component", "left").select(
            "node",
            "before",
            F.least("component", F.coalesce("up", "component")).alias("component"),
        )
        labels = written(jumped)
        if labels.filter("before <> component").isEmpty():
            return labels.select("node", "component")
