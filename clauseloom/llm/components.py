"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.plans.stage import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for ``edges`` (``a``, ``b``).

    Labels spread along edges and then jump to the label of their label, so a chain shrinks by half a round. Minima
    combine before the shuffle, so a node with very many edges is no burden; every round is written to the shared
    folder. Nodes without edges do not occur.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        spread = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = stage(
            spread.join(jump, "to", "left").select(
                "node", F.least("to", F.coalesce("further", "to")).alias("label"), "was",
            ),
            "labels",
        )
        before, labels = labels, moved.drop("was")
        done = moved.filter("label <> was").isEmpty()
        discard(before)
        labels.staged_at = moved.staged_at
        if done:
            discard(both)
            return labels
