"""Connected components of links, by minimum labels with pointer jumping; every round is a few shuffles of small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node that a link names; label is the least node reachable. Ends when a round changes nothing."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        better = stage(better, "labels")
        jumped = better.join(better.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        nxt = stage(jumped.select("node", F.least("label", F.coalesce("far", "label")).alias("label"), (F.least("label", F.coalesce("far", "label")) < F.col("old")).alias("changed")), "labels")
        going = not nxt.where("changed").isEmpty()
        unstage(labels, better)
        labels = nxt
        if not going:
            unstage(edges)
            return labels.select("node", "label")
