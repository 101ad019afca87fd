"""Graph walks as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import written


def bounded_walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """hop, src, dst, relation of the edges met within ``depth`` hops; edges to
    nodes seen before are reported, but the walk does not go on from them."""
    seen = start.select("node").distinct()
    frontier = seen
    out = None
    for hop in range(1, depth + 1):
        met = edges.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")
        step = met.select(F.lit(hop).alias("hop"), "src", "dst", "relation").distinct()
        out = step if out is None else out.unionByName(step)
        if hop < depth:
            frontier = met.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
            seen = seen.unionByName(frontier)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node): minimum labels with pointer jumping.

    Rounds are written as tables: a checkpoint keeps the constraints of its plan,
    and those of nested least() multiply with every round on the driver."""
    both = written(
        edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
        .unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        .distinct()
    )
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other")
            .groupBy("node").agg(F.min("l").alias("l"))
        )
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        best = F.least("label", "l", F.coalesce("up", "label"))
        step = written(
            labels.join(near, "node").join(hop, "label", "left")
            .select("node", best.alias("new"), (best != F.col("label")).alias("moved"))
        )
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
