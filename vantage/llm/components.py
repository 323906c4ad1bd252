"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.base import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of that label, so a chain of
    n nodes takes about log n rounds.  Minima are combined before the shuffle; a node with very many
    neighbours is no burden to one task.
    """
    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        )
        lower = labels.join(near, "node").select("node", F.least("component", "c").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("up"))
        after = cut(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("up", "to")).alias("component"), "was"))
        moved = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
