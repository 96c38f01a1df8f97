"""Logs of chains, and stores of results by the digest of a cluster's ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str) -> None:
    """Append samples ``chain, gen, …`` to a tab-separated log, a folder for each chain; all columns after ``gen`` are numbers."""
    samples.write.partitionBy("chain").option("header", True).mode("append").csv(path, sep="\t")


def read_samples(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``chain, gen`` and the number ``columns`` of a log."""
    schema = ", ".join(["gen long", *[f"`{c}` double" for c in columns], "chain int"])
    return spark.read.schema(schema).option("header", True).csv(path, sep="\t").select("chain", "gen", *columns)


def resume_points(samples: DataFrame) -> DataFrame:
    """The last sample of each chain, from which a stopped search goes on; no rows without samples."""
    others = [c for c in samples.columns if c != "chain"]
    return samples.groupBy("chain").agg(F.max_by(F.struct(*others), "gen").alias("last")).select("chain", "last.*")


def cluster_hash(ids: Column) -> Column:
    """Digest of a cluster's array of ids, whatever their order."""
    return F.md5(F.array_join(F.array_sort(ids), ", "))


def looked_up(clusters: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters ``hash, …`` with the columns of their row in ``store(hash, …)``, and those that it lacks.

    The store holds one row a hash; clusters of one hash each get it.
    """
    return clusters.join(store, "hash"), clusters.join(store.select("hash"), "hash", "left_anti")
