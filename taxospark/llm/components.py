"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node reachable over the links, both ways.

    Each round spreads the smallest label to neighbours, then lets every node take its label's label, so long chains
    take a number of rounds about the logarithm of their length. Labels are written between rounds; both sides of each
    join come from files, which lets adaptive execution split the rows of a hub. Nothing but the number of changed
    labels comes to the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").filter("node != other").distinct(), "cc-edges")
    labels = written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        spread = written(near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "cc-spread")
        roots = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = written(spread.join(roots, "label").select("node", F.col("root").alias("label")), "cc-labels")
        settled = after.join(labels.withColumnRenamed("label", "old"), "node").filter("label != old").isEmpty()
        labels = after
        if settled:
            return labels


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(node, ...) with `group`, the smallest node reachable over the links, or the node itself."""
    return nodes.join(components(links), "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
