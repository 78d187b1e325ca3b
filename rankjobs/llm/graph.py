"""Connected components of a graph given as edges, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.sources.artifacts import stage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node that has an edge, with the smallest node of its component.

    Each round links every node to the smallest label around it and then takes the label
    of that label, so the distance to the root about halves. A star with a hot centre is
    one pre-aggregated row per task on the way in, and a skewed join side on the way
    out, which adaptive execution splits. The loop ends when no label changes.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = stage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        moved = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("next"))
        # the root's own label is a shorter way
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = stage(
            moved.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("further", "next")).alias("next")),
            "labels",
        )
        changed = moved.filter("next <> root").isEmpty()
        labels = moved.select("node", F.col("next").alias("root"))
        if changed:
            return labels
