"""Connected components of an edge table, kept in tables all along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component, changed`` (false) of every node in ``edges`` (columns a, b); the component is its least node.

    Each round a node takes the least label around it and then its label's
    label, so long chains close in about a logarithmic number of rounds. Every
    round is written to the shared folder, which cuts the lineage.
    """
    both = scratch.table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct())
    labels = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component"), F.lit(True).alias("changed")))
    while True:
        around = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("next"))
        # The label's own label: a label is a node of the same component.
        of_label = lower.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        least = F.least("next", "jump")
        stepped = scratch.table(lower.join(of_label, "next").select("node", least.alias("component"), (least < F.col("component")).alias("changed")))
        scratch.drop(labels)
        labels = stepped
        if stepped.filter("changed").isEmpty():
            scratch.drop(both)
            return labels
