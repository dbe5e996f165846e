"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


def _stars(edges: DataFrame, large: bool, stage: Stage) -> DataFrame:
    """One star step, written: every neighbour on one side is tied to the smallest neighbour.

    The smallest neighbours are written before they are joined, so that the join has an
    exchange of its own on either side, which adaptive execution can split at a hub.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage.table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    made = stage.table(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stage.drop(least)
    return made


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) of every node that has an edge (u, v); root is the component's smallest node.

    A node's smallest neighbour comes from a partial aggregate, and the rows of a hub are only
    joined, never gathered. The last two rounds are compared by the number of edges and a sum
    of their hashes.
    """
    now = stage.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(now)
    while seen[0]:
        half = _stars(now, True, stage)
        after = _stars(half, False, stage)
        stage.drop(now)
        stage.drop(half)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
