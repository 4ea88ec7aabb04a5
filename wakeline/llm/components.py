"""Connected components by smallest labels, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.sources.scratch import materialize


def smallest_in_component(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the smallest node that is connected to each.

    A round takes the smallest label among a node's neighbours, then the label of that label, which
    halves the way to the smallest node. Only sums and joins by node; nothing is collected but a count.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
    )
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        new = materialize(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via")), "labels"
        )
        far = new.select(F.col("node").alias("via"), F.col("via").alias("far"))
        new = materialize(
            new.join(far, "via").select("node", "old", F.least("via", "far").alias("label")), "labels"
        )
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels
