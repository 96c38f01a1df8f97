"""Writers and readers of scores, sequences and profiles, names, sizes and the choice of a score."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns
from graphloom.operators import scoring, tree
from graphloom.sources import clusters, progress, sequences


def test_fasta_round_trip(spark, tmp_path):
    rows = [("x-1", "some words", "MPQSA"), ("y-2", "", "M-P"), ("z-3", None, "MM")]
    table = spark.createDataFrame(rows, "id string, description string, seq string")
    sequences.write_fasta(table, str(tmp_path / "with"))
    sequences.write_fasta(table.drop("description"), str(tmp_path / "without"))
    got = sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / "with")).collect()))
    assert got == [(i, d or "", s) for i, d, s in rows]
    assert {(r["id"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "without")).collect()} == {(i, s) for i, _, s in rows}
    assert [r["id"] for r in sequences.by_length(table).collect()] == ["x-1", "y-2", "z-3"]


def test_profiles_out(spark, tmp_path):
    rows = [(i, k, "M", "C", 0.5, 0.25, 0.25 * k) for i in ("a", "b") for k in (2, 0, 1)]
    table = spark.createDataFrame(rows, "id string, indx int, aa string, ss string, coil_prob double, helix_prob double, sheet_prob double")
    sequences.write_profiles(table, str(tmp_path / "ss2"))
    for i in ("a", "b"):
        lines = [r["value"] for r in spark.read.text(str(tmp_path / f"ss2/id={i}")).collect()]
        assert lines == ["0 M C 0.5 0.25 0.0", "1 M C 0.5 0.25 0.25", "2 M C 0.5 0.25 0.5"]
        back = sequences.read_profiles(spark, str(tmp_path / f"ss2/id={i}"))
        assert sorted((r["indx"], r["sheet_prob"]) for r in back.collect()) == [(k, 0.25 * k) for k in range(3)]


def test_scores_round_trip(spark, tmp_path):
    rows = [("a", "b", 0.1, 0.2, 0.3, 0.4), ("a", "c", -1.5, 0.0, 1e-9, None)]
    sequences.write_scores(spark.createDataFrame(rows, sequences.EDGE_SCHEMA), str(tmp_path / "edges"), "\t")
    assert sorted(map(tuple, sequences.read_scores(spark, str(tmp_path / "edges"), separator="\t").collect())) == rows


def test_forward_scores(spark, tmp_path):
    (tmp_path / "x-1.hmm").write_text("# header\ny-2 10.5 9.5 8.5 7.5\n  x-1   20 19 18 17\n")
    rows = sequences.read_forward_scores(spark, str(tmp_path / "x-1.hmm")).collect()
    assert sorted(map(tuple, rows)) == [("x-1", "x-1", 20.0), ("x-1", "y-2", 10.5)]


def test_names_and_sizes(spark):
    ids = spark.createDataFrame([("Aaa-b-c",), ("plain",), ("-x",)], "id string")
    assert [r[0] for r in ids.select(columns.without_taxon(F.col("id"))).collect()] == ["b-c", "plain", "x"]
    rows = [(c, f"{c}{k}") for c, n in (("Group_1", 1), ("group_2", 2), ("GROUP_3", 4)) for k in range(n)]
    members = spark.createDataFrame(rows, "cluster string, id string")
    assert {r["cluster"] for r in clusters.group_lines(members, 2, 3).collect()} == {"group_2"}
    assert {r["cluster"] for r in clusters.group_lines(members, names=["group_1", "Group_3"]).collect()} == {"Group_1", "GROUP_3"}


def test_choice_of_score(spark):
    members = spark.createDataFrame([("a", "x1", "x"), ("a", "y1", "y"), ("b", "x2", "x"), ("b", "x3", "x")], "cluster string, id string, taxon string")
    root = members.select("id", "taxon")
    one = {r["cluster"]: r["score"] for r in scoring.cluster_scores(members, root).collect()}
    other = {r["cluster"]: r["score"] for r in scoring.cluster_scores(members, root, "replicate").collect()}
    assert one.keys() == other.keys() == {"a", "b"} and one["a"] > one["b"] and other["a"] > other["b"] and one != other
    with pytest.raises(ValueError, match="no score"):
        scoring.cluster_scores(members, root, "other")


def test_leaves_and_totals(spark, tmp_path):
    table = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "id long, parent long")
    assert sorted(r["id"] for r in tree.leaves(table).collect()) == [2, 4]
    path = str(tmp_path / "step")
    assert progress.read_totals(spark, path) is None
    told = progress.write_counted(table, path, rows=F.count("*"), roots=F.count_if(F.col("parent").isNull()))
    assert told == progress.read_totals(spark, path) == {"rows": 4, "roots": 1} and spark.read.parquet(f"{path}/rows").count() == 4
