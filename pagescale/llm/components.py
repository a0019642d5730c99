"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import cut_lineage, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and then its label's label, so the number of
    rounds grows with the logarithm of the longest path. Minima are combinable; each round is a written table, and only
    the last one stays.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both, "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        step = cut_lineage(near.join(up, "label").select("node", "was", F.least("label", "jump").alias("component")), "labels")
        discard(labels)
        if step.where("was <> component").isEmpty():
            discard(both)
            return step.select("node", "component")
        labels = step.select("node", "component")
