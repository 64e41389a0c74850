"""Connected components of an undirected graph, smallest member as label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours and then the
    label of the label, so that paths shorten by half; it ends when no label
    changes. Every round is written, and its plan starts from files.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = nearer.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("changed"))
        stepped = written(stepped, "labels")
        if not stepped.where("changed").limit(1).count():
            return stepped.select("node", "label")
        labels = stepped.select("node", "label")
