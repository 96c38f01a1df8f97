"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.staging import drop_staged, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Attach every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (
        both.filter(F.col("b") > F.col("a"))
        .join(low, "a")
        .filter(F.col("b") != F.col("low"))
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Attach a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats, loops and
    nulls do not matter.  Returns ``id, component`` where ``component`` is the
    smallest node reachable.  Every round is two aggregations and two joins on
    node ids, all of them partially aggregated or splittable by the adaptive skew
    join, and ends in a staged table, so neither a hub nor the number of rounds
    gathers anything in one task or in the plan.
    """
    now = stage(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        after = stage(_small_star(_large_star(now)), "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
