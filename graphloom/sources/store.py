"""A store of rows by digest that several runs may fill at once.

Every append is written aside as a table of its own and then enters the store by a numbered
manifest that names it; a number is taken by creating its file, which only one writer can
do.  Of rows under one digest those of the append with the smallest number count, so
readers agree whoever wrote first, and a writer that dies leaves nothing that is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, table) of every append in the store: a name for each."""
    at, files = _folder(spark, f"{path}/manifests")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    found = [n.split("-", 1) for n in names if n[:1].isdigit() and "-" in n]
    return sorted((int(number), table) for number, table in found)


def append(rows: DataFrame, path: str, key: str = "hash") -> None:
    """Add ``rows`` to the store below ``path``; those of a digest that it already has are left out.

    Two writers of one digest may both add it; the first to enter counts.  Rows without a
    digest are not kept.
    """
    spark, table = rows.sparkSession, uuid.uuid4().hex
    known = read(spark, path, key)
    fresh = rows.filter(F.col(key).isNotNull())
    fresh = fresh if known is None else fresh.join(known.select(key).distinct(), key, "left_anti")
    fresh.write.parquet(f"{path}/tables/{table}")
    _, files = _folder(spark, path)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}")
    number = max([n for n, _ in manifests(spark, path)], default=0) + 1
    while not files.createNewFile(at(f"claim.{number}")):  # another writer has this number
        number += 1
    files.createNewFile(at(f"{number}-{table}"))


def read(spark: SparkSession, path: str, key: str = "hash") -> DataFrame | None:
    """The rows of the store, each digest's from the first append that has it; None for a store without appends.

    A digest may have several rows (the edges of a graph); they come from one append.
    """
    entries = manifests(spark, path)
    if not entries:
        return None
    parts = [spark.read.parquet(f"{path}/tables/{table}").withColumn("_entry", F.lit(number)) for number, table in entries]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = rows.groupBy(key).agg(F.min("_entry").alias("_entry"))
    return rows.join(first, [key, "_entry"]).drop("_entry")
