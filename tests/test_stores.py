"""Round trips of cluster exports, chain logs and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.sources import clusters, samples, sequences

ROWS = [("g1", "a-1"), ("g1", "b-1"), ("g1", "c-1"), ("g2", "a-2")]


def test_raw_clusters(spark, tmp_path):
    members = spark.createDataFrame([*ROWS, ("g2", None)], "cluster string, id string")
    clusters.write_raw_clusters(members, f"{tmp_path}/raw")
    rows = clusters.read_clusters(spark, f"{tmp_path}/raw").groupBy("line").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    assert sorted(r["ids"] for r in rows.collect()) == [["a-1", "b-1", "c-1"], ["a-2"]]


def test_exports(spark, tmp_path):
    members = spark.createDataFrame(ROWS, "cluster string, id string")
    texts = [("a-1", "first one", "MA-K"), ("b-1", None, "MARK"), ("c-1", "", "MTRK"), ("a-2", "x", None), ("z", "not a member", "M")]
    known = spark.createDataFrame(texts, "id string, description string, seq string")
    clusters.write_groups(clusters.exported_records(members, known), f"{tmp_path}/seqs")
    back = sequences.read_fasta(spark, f"{tmp_path}/seqs/cluster=g1")
    assert {(r["id"], r["description"], r["seq"]) for r in back.collect()} == {("a-1", "first one", "MA-K"), ("b-1", "", "MARK"), ("c-1", "", "MTRK")}
    assert [r["value"] for r in clusters.exported_records(members.filter("cluster = 'g2'"), known).collect()] == [">a-2 x\n"]
    assert [tuple(r) for r in clusters.exported_consensus(members, known).collect()] == [("g1", ">g1\nMARK")]


def test_samples(spark, tmp_path):
    kind = "chain int, gen long, inflation double, result double"
    rows = [(c, g, 1.5 + g, float(c)) for c in range(2) for g in range(5)]
    for part in (rows[:3], rows[3:]):
        samples.write_samples(spark.createDataFrame(part, kind), f"{tmp_path}/log")
    back = samples.read_samples(spark, f"{tmp_path}/log", ["inflation", "result"])
    assert sorted(map(tuple, back.collect())) == rows
    assert sorted(map(tuple, samples.resume_points(back).collect())) == [(0, 4, 5.5, 0.0), (1, 4, 5.5, 1.0)]
    assert samples.resume_points(back.limit(0)).count() == 0


def test_lookup(spark):
    held = spark.createDataFrame([("g1", ["b", "a"]), ("g2", ["c"])], "cluster string, ids array<string>")
    hashed = held.select("cluster", samples.cluster_hash(F.col("ids")).alias("hash"))
    store = spark.createDataFrame([(["a", "b"], "kept")], "ids array<string>, graph string").select(samples.cluster_hash(F.col("ids")).alias("hash"), "graph")
    found, missing = samples.looked_up(hashed, store)
    assert [(r["cluster"], r["graph"]) for r in found.collect()] == [("g1", "kept")]
    assert [r["cluster"] for r in missing.collect()] == ["g2"]
