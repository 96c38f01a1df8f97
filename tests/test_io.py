"""Files, streams and the recursive grouping job."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphloom.jobs import orthogroups
from graphloom.sources import clusters, sequences
from graphloom.streaming import heartbeat


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x-1 some words\nMPq\nSA-\n>y-2\nM*P\n>z-3 empty\n\n")
    rows = {r["id"]: (r["description"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"x-1": ("some words", "MPQSA-"), "y-2": ("", "M*P")}


def test_profiles(spark, tmp_path):
    (tmp_path / "x-1.ss2").write_text("# a comment\n\n   1 M C   0.999  0.001  0.000\n   2 P H   0.1  0.8  0.1\n")
    rows = sequences.read_profiles(spark, str(tmp_path / "x-1.ss2")).orderBy("indx").collect()
    assert [(r["id"], r["indx"], r["aa"], r["helix_prob"]) for r in rows] == [("x-1", 1, "M", 0.001), ("x-1", 2, "P", 0.8)]


def test_cluster_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("group_0_1\t12.5\ta\tb\ngroup_0_2 c d\ne\tf\n\n")
    got = {}
    for r in clusters.read_clusters(spark, str(tmp_path / "c.txt")).orderBy("line", "pos").collect():
        got.setdefault((r["cluster"], r["score"]), []).append(r["id"])
    assert got == {("group_0_1", 12.5): ["a", "b"], ("group_0_2", None): ["c", "d"], (None, None): ["e", "f"]}


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=m), k % 2, "click", 1.0) for k, m in enumerate([0, 10, 20, 70, 80, 600, 1200])]
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    for part in (rows[:4], rows[4:6], rows[6:]):
        table = pa.table({n: pa.array([r[i] for r in part], pa.timestamp("us") if n == "ts" else None) for i, n in enumerate(names)})
        pq.write_table(table, tmp_path / f"{part[0][0]}.parquet")
    beats = heartbeat.stream_of(spark, str(tmp_path))
    for name, df in (("hours", heartbeat.hourly_stream(beats)), ("gone", heartbeat.evictions(beats, 3600))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"_{name}")).start()
        q.processAllAvailable()
        q.stop()
    hours = {r["hour"].hour: r["pulses"] for r in spark.table("hours").collect()}
    assert hours[0] == 3
    assert hours[1] == 2
    assert {r["thread_id"] for r in spark.table("gone").collect()} <= {0, 1}


def test_orthogroups(spark):
    rng = np.random.default_rng(0)
    families = {f"t{t}-{f}": rng.normal(0, 0.1, 8) + 5 * np.eye(8)[k] for k, f in enumerate("abc") for t in range(5)}
    ids = sorted(families)
    rows = [(a, b, float(1 / (1 + np.linalg.norm(families[a] - families[b]))), 0.5 + 0.01 * float(rng.random())) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    edges = spark.createDataFrame(rows, "seq1 string, seq2 string, subsmat double, psi double")
    members = spark.createDataFrame([(i, i.split("-")[0]) for i in ids], "id string, taxon string")
    groups = orthogroups.orthogroups(members, edges, steps=10)
    got = {frozenset(r["ids"]) for r in groups.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == {frozenset(i for i in ids if i.endswith(f)) for f in "abc"}
    assert orthogroups.scored_groups(groups, members).count() == 3
