"""Closure of lineage edges from many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.session import checkpointed


class BrokenLineage(ValueError):
    """A feature parent is absent from the value table."""


def feature_nodes(values: DataFrame, lineage_ids: DataFrame) -> DataFrame:
    """LIN-02: stored nodes of the requested ids."""
    return values.join(lineage_ids.select("lineage_id").distinct(), "lineage_id", "left_semi")


def trace(edges: DataFrame, roots: DataFrame, *, max_depth: int = 32, values: DataFrame | None = None) -> DataFrame:
    """LIN-03, JN-23: (root_id, node_id, node_kind, depth) for every reachable node.

    Each hop is one join of the frontier with the edges.  The reached set is checkpointed per
    hop, so a lost executor never replays the whole chain of hops.
    """
    frontier = roots.select(F.col("lineage_id").alias("root_id"), F.col("lineage_id").alias("node_id")).distinct()
    reached = checkpointed(frontier.select("root_id", "node_id", F.lit("feature").alias("node_kind"), F.lit(0).alias("depth")))
    frontier = reached.select("root_id", "node_id")
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges.withColumnRenamed("lineage_id", "node_id"), "node_id").select(
            "root_id", F.col("parent_id").alias("node_id"), F.col("parent_kind").alias("node_kind")
        ).distinct()
        step = step.join(reached, ["root_id", "node_id"], "left_anti")
        step = checkpointed(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        frontier = step.filter("node_kind = 'feature'").select("root_id", "node_id")
    else:
        raise ValueError(f"lineage is deeper than {max_depth} hops")
    if values is not None:
        missing = reached.filter("node_kind = 'feature'").select(F.col("node_id").alias("lineage_id")).distinct().join(values, "lineage_id", "left_anti")
        if not missing.isEmpty():
            raise BrokenLineage("lineage refers to nodes that are not stored")
    return reached
