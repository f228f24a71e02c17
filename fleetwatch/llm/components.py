"""Connected components of a large graph, by smallest labels and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, label), the smallest node of its component.

    Each round takes the smallest label around every node and then the label of that
    label; it is written to the shared folder, and the rounds end when none changes.
    Labels and links stay on the executors; only the number of changes comes back."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("near_node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("near_node")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("to"))
        after = materialize(lower.join(jump, F.col("label") == F.col("at")).select("node", "old", F.col("to").alias("label")), "labels")
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
