"""Tables written to the folder that driver and executors share.

A staged table cuts the lineage: a lost executor costs the tasks that ran on it,
never a recomputation of everything before.  The folder is the one that the
cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a
laptop) a folder below the warehouse is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, as the session has it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"
    return base.rstrip("/") + "/graphloom"


_noting: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all tables that are staged meanwhile."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting.remove(paths)


def stage(df: DataFrame, label: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by), compression=compression)
    for paths in _noting:
        paths.append(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by :func:`stage` once nothing reads it any more."""
    path = getattr(df, "_staged_at", None)
    if path is not None:
        delete(df.sparkSession, path)
