"""Trees of clusters, given as ``id, parent``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.staging import drop_staged, stage


def roots(tree: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, root, depth`` of every node: the end of its way up and the steps to it.

    Ways double every round, so a tree of depth n takes log2(n) rounds, each a join of the
    nodes with themselves.  A node whose parent is null or no node of the tree is a root, of
    depth 0; nodes on or under a circle of parents have neither root nor depth.  Of rows
    that repeat an id that with the smallest parent counts.
    """
    rows = tree.groupBy("id").agg(F.min("parent").alias("parent")).filter("id is not null")
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    start = rows.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).otherwise(F.col("id")).alias("up"))
    now = stage(start.select("id", "up", (F.col("up") != F.col("id")).cast("long").alias("depth")), "ways")
    # a node that is its own parent is on a circle
    itself = stage(rows.filter("id = parent").select("id"), "itself")
    size = now.count()
    for _ in range(max_rounds):
        further = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        after = now.select("id", "up", "depth").join(further, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        after = stage(after, "ways")
        # ways on a circle double for ever: those longer than there are nodes are let be
        over = after.filter((F.col("more") > 0) & (F.col("depth") <= size)).isEmpty()
        drop_staged(now)
        now = after
        if over:
            break
    ends = start.filter("id = up").select(F.col("id").alias("up")).join(itself.withColumnRenamed("id", "up"), "up", "left_anti").withColumn("ends", F.lit(True))
    out = now.join(ends, "up", "left")
    fine = F.col("ends") & (F.col("depth") < size)
    return out.select("id", F.when(fine, F.col("up")).alias("root"), F.when(fine, F.col("depth")).alias("depth"))


def leaves(tree: DataFrame) -> DataFrame:
    """``id`` of the nodes that are no node's parent."""
    above = tree.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
    return tree.select("id").join(above, "id", "left_anti")
