"""Connected components by label propagation with pointer jumping, on tables that Spark keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import drop_stored, stored


#: Edges that one task of a round should take.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, count: int | None = None) -> DataFrame:
    """(node, label): label is the smallest node of each component. edges: (a, b) longs without nulls, some `count` of them if that is known; nodes without an edge do not appear.

    Each round lowers labels to the least of the neighbours' and then jumps to the label's own label, so the number of rounds
    grows with the logarithm of the longest path. Every round is written to the shared folder and the one before deleted.
    """
    every = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(every if count is None else every.coalesce(max(2, 2 * count // EDGES_A_TASK)), "edges")
    tasks = max(2, both.count() // EDGES_A_TASK)  # small graphs need few tasks, whatever the shuffle's partitions
    near_by = both.coalesce(tasks)
    labels = stored(near_by.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")).coalesce(tasks), "labels")
    while True:
        near = near_by.join(labels, near_by["b"] == labels["node"]).coalesce(tasks).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").coalesce(tasks).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(lower.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")).coalesce(tasks), "labels")
        drop_stored(labels)
        labels = new.select("node", "label")
        labels.stored_at = new.stored_at
        if not new.where("label < old").limit(1).count():
            drop_stored(both)
            return labels
