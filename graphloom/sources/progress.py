"""Totals of a table, counted while it is written, as a JSON file beside it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def write_counted(rows: DataFrame, path: str, /, **totals: Column) -> dict:
    """Write ``rows`` as Parquet to ``path/rows`` and the aggregates ``totals`` of what was written to ``path/totals.json``.

    The totals are observed by the tasks that write, so the table is not read again.  The
    file appears after the table is whole, so whoever finds it finds a finished step.
    """
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in totals.items()]).write.parquet(f"{path}/rows")
    found = {name: seen.get.get(name) for name in totals}
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals.json")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(found, default=str).encode()))
    out.close()
    return found


def read_totals(spark: SparkSession, path: str) -> dict | None:
    """The totals of a finished step, None before that."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals.json")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(str(at)).collect()))  # one short file
