"""Copies of rows for pairs of blocks, and what pair queries shuffle, grow like the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import similarity


def test_a_row_has_as_many_copies_in_a_large_table_as_in_a_small_one(spark):
    def copies(n, by=None):
        rows = spark.range(n).select("id", (F.col("id") % 3).alias("g"))
        return similarity.block_pairs(rows, similarity.BLOCK, by).count() / n

    assert copies(40_000) == copies(2_000) > 1
    assert copies(40_000, "g") == copies(4_000, "g") > 1
