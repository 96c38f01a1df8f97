"""Heartbeats of workers: who is alive, and counts per hour, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEAD_AFTER_S = 120


def pulses(events: DataFrame) -> DataFrame:
    """``thread_id, thread_type, pulse`` of a table or stream of events."""
    return events.select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("thread_type"), F.col("ts").alias("pulse"))


def liveness(beats: DataFrame, wait_s: int = DEAD_AFTER_S) -> DataFrame:
    """``thread_id, pulse, alive``: the last pulse of each thread against the last of all."""
    last = beats.groupBy("thread_id").agg(F.max("pulse").alias("pulse")).withColumn("_1", F.lit(1))
    now = last.agg(F.max("pulse").alias("now")).withColumn("_1", F.lit(1))
    alive = F.col("pulse") > F.col("now") - F.make_dt_interval(secs=F.lit(wait_s))
    return last.join(F.broadcast(now), "_1").select("thread_id", "pulse", alive.alias("alive"))


def monitor(beats: DataFrame) -> DataFrame:
    """Pulses and threads of each type, and when they were first and last seen."""
    return beats.groupBy("thread_type").agg(
        F.count("*").alias("pulses"), F.countDistinct("thread_id").alias("threads"), F.min("pulse").alias("first_pulse"), F.max("pulse").alias("last_pulse")
    )


def per_hour(beats: DataFrame) -> DataFrame:
    """Pulses of each type in each hour."""
    return beats.groupBy(F.date_trunc("hour", "pulse").cast("timestamp_ntz").alias("hour"), "thread_type").agg(F.count("*").alias("pulses"))


def stream_of(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream of pulses (pulse as a timestamp with zone)."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return pulses(rows).withColumn("pulse", F.col("pulse").cast("timestamp"))


def hourly_stream(beats: DataFrame, late: str = "2 hours") -> DataFrame:
    """Pulses per type in hourly windows; a window ends once the watermark passes it."""
    return (
        beats.withWatermark("pulse", late).groupBy(F.window("pulse", "1 hour"), "thread_type").agg(F.count("*").alias("pulses"))
        .select(F.col("window.start").alias("hour"), "thread_type", "pulses")
    )


def evictions(beats: DataFrame, wait_s: int = DEAD_AFTER_S) -> DataFrame:
    """``thread_id, last_pulse``: a row for each thread that falls silent for ``wait_s`` of event time.

    State is one timestamp per live thread; the event-time timer removes it with the row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"thread_id": [key[0]], "last_pulse": [pd.Timestamp(last, unit="ms", tz="UTC")]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pd.to_datetime(pdf["pulse"]).max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + wait_s * 1000, state.getCurrentWatermarkMs() + 1))

    marked = beats.withWatermark("pulse", "0 seconds")
    return marked.groupBy("thread_id").applyInPandasWithState(
        run, "thread_id long, last_pulse timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
