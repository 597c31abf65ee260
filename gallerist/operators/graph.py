"""Connected components of an edge table, by label propagation with pointer jumping on shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gallerist.storage import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that an edge of (a, b) names; nulls and loops are dropped.

    Each round a node takes the least label among its own and its neighbours', then that label's own label, so paths
    halve. Every round is written to the shared folder: nothing is held in an executor alone, nothing reaches the driver
    but one count of changes.
    """
    clean = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(clean.union(clean.select("b", "a")).toDF("id", "other").distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        known = labels.withColumnRenamed("id", "other").withColumnRenamed("component", "theirs")
        near = both.join(known, "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        near = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("theirs", "component")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = written(
            near.join(jump, "next", "left").select("id", "component", F.least("next", F.coalesce("far", "next")).alias("next")), "labels"
        )
        changed = moved.where("component <> next").limit(1).count()
        drop_written(labels)
        labels = moved.select("id", F.col("next").alias("component"))
        labels._written_path = moved._written_path
        if not changed:
            drop_written(both)
            return labels
