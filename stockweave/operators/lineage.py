"""Transitive lineage: everything an artifact was made from, and everything made from it.

One join per step of depth: the newest (artifact, ancestor) pairs meet the edges, pairs known already are left out, and the step's
pairs are written before the next one, so a lost executor costs one step. The number of steps is the depth of the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.session import cut_lineage

ARTIFACT, INPUT = ("dataset_id", "version"), ("input_id", "input_version")


class LineageCycle(ValueError):
    """An artifact is among its own inputs."""


def ancestors(edges: DataFrame, drifted: Column | None = None) -> DataFrame:
    """``dataset_id, version, ancestor_id, ancestor_version, depth, drifted`` of every artifact and all it depends on.

    ``edges``: (dataset_id, version, input_id, input_version). ``depth`` is the least number of steps. An ancestor has drifted if an
    edge to it, from the artifact or from another of its ancestors, fulfils the condition ``drifted``. Repeated edges count once.
    """
    drift = F.coalesce(drifted, F.lit(False)) if drifted is not None else F.lit(False)
    pairs = edges.select(F.struct(*ARTIFACT).alias("child"), F.struct(*[F.col(i).alias(a) for i, a in zip(INPUT, ARTIFACT)]).alias("parent"), drift.alias("drift"))
    pairs = cut_lineage(pairs.groupBy("child", "parent").agg(F.max("drift").alias("drift")))
    step = pairs.select(F.col("child").alias("root"), F.col("parent").alias("node"), F.lit(1).alias("depth"))
    reached, depth = step, 1
    while not step.isEmpty():
        loops = step.where(F.col("root") == F.col("node")).select("root.*").take(3)
        if loops:
            raise LineageCycle(f"artifacts among their own inputs, for example {[tuple(r) for r in loops]}")
        depth += 1
        found = step.join(pairs, F.col("node") == F.col("child")).select("root", F.col("parent").alias("node")).distinct()
        step = cut_lineage(found.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(step)
    members = reached.select("root", "node").unionByName(pairs.select(F.col("child").alias("root"), F.col("child").alias("node")).distinct())
    seen = members.join(pairs, F.col("node") == F.col("child")).groupBy("root", F.col("parent").alias("node")).agg(F.max("drift").alias("drifted"))
    out = reached.join(seen, ["root", "node"])
    return out.select("root.*", F.col(f"node.{ARTIFACT[0]}").alias("ancestor_id"), F.col(f"node.{ARTIFACT[1]}").alias("ancestor_version"), F.col("depth").cast("bigint").alias("depth"), "drifted")


def impact(edges: DataFrame) -> DataFrame:
    """``dataset_id, version, dependants, furthest``: how many artifacts depend on each input, and over how many steps."""
    closure = ancestors(edges)
    return closure.groupBy(F.col("ancestor_id").alias("dataset_id"), F.col("ancestor_version").alias("version")).agg(
        F.count(F.lit(1)).alias("dependants"), F.max("depth").alias("furthest")
    )
