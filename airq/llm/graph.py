"""Connected components by minimum labels with pointer jumping, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(v, component)``: the smallest vertex reachable, for every vertex with an edge.

    Loops, repeated edges and either direction are fine; null ends are ignored; no edge gives no row.
    Each round takes the smallest label among a vertex's neighbours and then that label's own label,
    so chains halve; a round is written to the shared folder, which also ends its lineage.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    both = materialise(ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        step = materialise(step, "step")
        jump = step.select(F.col("v").alias("step"), F.col("step").alias("component"))
        moved = materialise(step.join(jump, "step").select("v", "component", (F.col("component") < F.col("old")).alias("moved")), "labels")
        labels = moved.select("v", "component")
        if moved.where("moved").isEmpty():
            return labels
