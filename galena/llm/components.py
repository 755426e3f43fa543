"""Connected components of a table of links, by rounds of joins whose results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.shared import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of the links (a, b: bigint): component is the smallest node it is linked with.

    Each round hooks every node, and the smallest neighbour it knows, onto the smallest node known to both, and follows
    the hooks once more; labels reach the far end of a chain in a logarithmic number of rounds. A node's links are
    reduced to their minimum before they are shuffled, so a node with very many links needs no large task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        of_b = labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        of_a = labels.select(F.col("node").alias("a"), F.col("c").alias("ca"))
        # What a's label learns: the smallest label next to a, for a itself and for the node that a's label names.
        near = edges.join(of_b, "b").groupBy("a").agg(F.min("cb").alias("low")).join(of_a, "a")
        told = near.select(F.col("a").alias("node"), F.least("low", "ca").alias("c")).unionByName(near.select(F.col("ca").alias("node"), F.least("low", "ca").alias("c")))
        hooked = told.groupBy("node").agg(F.min("c").alias("c"))
        jump = hooked.select(F.col("node").alias("c"), F.col("c").alias("further"))
        new = written(hooked.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("c")), "labels")
        moved = new.join(labels.withColumnRenamed("c", "before"), "node").where("c <> before").limit(1).count()
        labels = new
        if not moved:
            return labels.select("node", F.col("c").alias("component"))
    raise RuntimeError("the components did not settle")
