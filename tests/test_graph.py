"""Graph operators, Markov clustering, placement, chains and comparison against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, graph, mcl, mcmc, placement, similarity
from graphloom.operators.components import connected_components

# Forward scores, a row per profile and a column per item.
ITEMS = ['BOL-PanxαB', 'Bab-PanxαA', 'Bch-PanxαA', 'Bfo-PanxαE']
FORWARD = (
    (702.0341, 641.091, 626.8386, 619.856),
    (636.7927, 696.4839, 663.5856, 623.7233),
    (627.4737, 668.5334, 702.3412, 619.3785),
    (615.9315, 624.091, 615.3356, 702.2801),
)
NAMES = ["Bab", "Cfu", "Mle", "Oma"]
PAIRS = [("Bab", "Cfu"), ("Bab", "Oma"), ("Bab", "Mle"), ("Cfu", "Mle"), ("Cfu", "Oma"), ("Oma", "Mle")]


def _edges(spark, weights):
    return spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(PAIRS, weights, strict=True)], "seq1 string, seq2 string, score double")


def _dense(matrix):
    out = np.zeros((4, 4))
    for r in matrix.collect():
        out[NAMES.index(r["i"]), NAMES.index(r["j"])] = r["w"]
    return out


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2200)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_transition_matrix(spark):
    got = _dense(mcl.transition_matrix(_edges(spark, [1, 1, 0, 0, 1, 0]), 0.6))
    third = np.array([[1, 1, 0, 1], [1, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]]) / 3
    assert np.allclose(got, third)
    dense = mcl.dense_transition(NAMES, [a for a, _ in PAIRS], [b for _, b in PAIRS], np.array([1.0, 1, 0, 0, 1, 0]), 0.6)
    assert np.allclose(dense, third)


def test_steps(spark):
    matrix = mcl.transition_matrix(_edges(spark, [1, 1, 0, 1, 1, 0]), 0.0)
    one = mcl.mcl_step(matrix, 2)
    assert _dense(one)[1] == pytest.approx([0.325268817204, 0.472222222222, 0.45, 0.325268817204], abs=1e-11)
    assert _dense(mcl.mcl_step(one, 2))[1] == pytest.approx([0.471649087074, 0.58116078281, 0.642542807074, 0.471649087074], abs=1e-11)


def test_clusters(spark):
    edges = _edges(spark, [0.9, 0.1, 0.1, 0.1, 0.1, 0.9])
    dense = mcl.dense_transition(NAMES, [a for a, _ in PAIRS], [b for _, b in PAIRS], np.array([0.9, 0.1, 0.1, 0.1, 0.1, 0.9]), 0.0)
    assert mcl.dense_clusters(NAMES, dense, 2) == [["Mle", "Oma"], ["Bab", "Cfu"]]
    nodes = spark.createDataFrame([(n,) for n in NAMES], "id string")
    got = {r["id"]: r["cluster"] for r in mcl.markov_clusters(edges, nodes, 2.0, 0.0).collect()}
    assert got == {"Bab": "Bab", "Cfu": "Bab", "Mle": "Mle", "Oma": "Mle"}
    assert mcl.markov_clusters(edges, nodes, 2.0, 0.0, max_steps=1).select("cluster").distinct().count() == 1
    by_group = mcl.clusters_by_group(edges.select(F.lit("g").alias("cluster"), "*", F.lit(2.0).alias("inflation"), F.lit(0.0).alias("threshold")))
    assert by_group.groupBy("part").count().count() == 2


def test_node_count():
    assert mcl.node_count(8911) == 134
    with pytest.raises(ValueError, match="complete graph"):
        mcl.node_count(7)


def test_alignment_score(spark):
    # The scores of the residues below in the 62 % block substitution matrix.
    own = {"M": 5, "P": 7, "Q": 5, "S": 4, "A": 4, "W": 11, "I": 4}
    other = {("Q", "P"): -1, ("S", "I"): -2, ("M", "Q"): 0, ("Q", "I"): -3, ("M", "I"): 1}
    table = [(a, a, float(v)) for a, v in own.items()]
    table += [(a, b, float(v)) for (x, y), v in other.items() for a, b in ((x, y), (y, x))]
    matrix = spark.createDataFrame(table, "a string, b string, value double")
    pairs = spark.createDataFrame([(1, "MP--QMSASWI", "MPPIQISAS-I")], "pair int, seq1 string, seq2 string")
    got = similarity.alignment_scores(pairs, matrix, -5.0, -1.0).first()["score"]
    assert got == pytest.approx(0.40982529375386517, abs=1e-12)


def test_profile_score(spark):
    rows = [("a", 0, 0.1, 0.2, 0.7), ("a", 1, 0.5, 0.5, 0.0), ("b", 1, 0.5, 0.25, 0.25), ("b", 2, 1.0, 0.0, 0.0)]
    profiles = spark.createDataFrame(rows, "id string, indx int, coil_prob double, helix_prob double, sheet_prob double")
    pairs = spark.createDataFrame([("a", "b")], "seq1 string, seq2 string")
    assert similarity.profile_scores(pairs, profiles).first()["psi"] == pytest.approx((3 - 0.5) / 3 / 3)


def test_constant_scores_scale_to_nan(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5, 0.5)], "seq1 string, seq2 string, subsmat double, psi double")
    assert math.isnan(similarity.with_final_scores(pairs).first()["score"])


def test_best_hits_and_closure(spark):
    rows = [("a", "b", 3.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "d", 0.5), ("b", "d", 0.1)]
    edges = spark.createDataFrame(rows, "seq1 string, seq2 string, raw_score double")
    hits = {(r["src"], r["dst"]) for r in graph.best_hits(edges).collect()}
    assert hits == {("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("d", "c")}
    assert {(r["seq1"], r["seq2"]) for r in graph.reciprocal_best_hits(edges).collect()} == {("a", "b"), ("a", "c")}
    reach = {(r["start"], r["id"]) for r in graph.best_hit_closure(edges).collect()}
    assert {i for s, i in reach if s == "d"} == {"a", "b", "c", "d"}
    assert {i for s, i in reach if s == "a"} == {"a", "b", "c"}


def test_collapse(spark):
    rows = [("x-1", "x-2", 9.0), ("x-1", "y-1", 5.0), ("x-2", "y-1", 4.0)]
    edges = spark.createDataFrame(rows, "seq1 string, seq2 string, raw_score double")
    members = spark.createDataFrame([("g", i, i[0]) for i in ("x-1", "x-2", "y-1")], "cluster string, id string, taxon string")
    got = {r["id"]: r["rep"] for r in graph.collapsed_paralogs(edges, members).collect()}
    assert got == {"x-1": "x-1", "x-2": "x-1", "y-1": "y-1"}


def _forward(spark):
    rows = [(h, r, x) for h, row in zip(ITEMS, FORWARD, strict=True) for r, x in zip(ITEMS, row, strict=True)]
    return spark.createDataFrame(rows, "hmm_id string, rec_id string, fwd_raw double")


def test_r_squared(spark):
    forward = _forward(spark)
    got = {(r["rec_id1"], r["rec_id2"]): r["r_square"] for r in placement.r_squared(forward).collect()}
    assert len(got) == 10
    assert got["BOL-PanxαB", "Bab-PanxαA"] == pytest.approx(0.016894041431, abs=1e-10)
    assert got["Bch-PanxαA", "Bfo-PanxαE"] == pytest.approx(0.390838714109, abs=1e-10)


def test_r_squared_of_blocks(spark):
    """Blocks of two items, missing values and constant items, against numpy."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 12)) + 50
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3] = 7.0
    rows = [(h, r, float(x[r, h])) for r in range(9) for h in range(12) if not np.isnan(x[r, h])] + [(0, 8, None), (None, 1, 2.0)]
    got = {(r["rec_id1"], r["rec_id2"]): r["r_square"] for r in placement.r_squared(spark.createDataFrame(rows, "hmm_id long, rec_id long, fwd_raw double"), block=2).collect()}
    assert len(got) == 45
    for a in range(9):
        for b in range(a + 1, 9):
            both = ~np.isnan(x[a]) & ~np.isnan(x[b])
            want = None if 3 in (a, b) else np.corrcoef(x[a][both], x[b][both])[0, 1] ** 2
            assert got[a, b] == (want if want is None else pytest.approx(want, abs=1e-9))


def test_truncated_pdf(spark):
    r2 = placement.r_squared(_forward(spark))
    row = r2.agg(F.round(F.avg("r_square"), 12).alias("mu"), F.round(F.stddev_pop("r_square"), 12).alias("sigma")).first()
    assert placement.truncated_pdf(0.8, row["mu"], row["sigma"]) == pytest.approx(1.0920223528477309, abs=1e-9)


def test_variable_draws():
    v = mcmc.Variable("foo", 2, 5, seed=1)
    assert v.current == v.draw == 2.403092732337
    draws = [v.propose(0.1) for _ in range(200)]
    assert all(2 <= d <= 5 for d in draws)
    assert v.current == 2.403092732337
    v.accept()
    assert v.current == draws[-1]
    with pytest.raises(ValueError, match="lower bound"):
        mcmc.Variable("foo", 5, 2)


def test_convergence(spark):
    """The factor of three chains against its formula; chains that have not met are far from 1."""
    rng = np.random.default_rng(2)
    for apart in (0.0, 3.0):
        x = rng.normal(size=(3, 100)) + apart * np.arange(3)[:, None]
        rows = [(k, g, "I", float(x[k, g])) for k in range(3) for g in range(100)]
        got = mcmc.psrf(spark.createDataFrame(rows, "chain int, gen int, variable string, value double")).first()["psrf"]
        assert (got < 1.1) == (apart == 0.0)


def test_search_finds_a_peak(spark):
    chains, (score, at) = mcmc.search(spark, {"x": (-4.0, 4.0)}, lambda p: 1 - (p[0] - 1) ** 2, steps=12, chains=2, seed=3)
    again = mcmc.search(spark, {"x": (-4.0, 4.0)}, lambda p: 1 - (p[0] - 1) ** 2, steps=12, chains=2, seed=3)[1]
    assert score > 0.8
    assert (score, at) == again
    assert all(len(c.samples) == 12 for c in chains)


def test_comparison(spark):
    def table(clusters):
        return spark.createDataFrame([(f"c{o}", o, i) for o, ids in enumerate(clusters) for i in ids], "cluster string, ord int, id string")

    same = compare.agreement(table(["abc", "de"]), table(["abc", "de"])).first()
    assert [same[k] for k in ("precision", "recall", "accuracy", "tn_rate")] == [1.0] * 4
    one = compare.agreement(table(["abc", "de"]), table(["ab", "c", "de"])).first()
    # c finds its true cluster claimed: no true positive, recall adds nothing
    assert one["precision"] == pytest.approx(4 / 5)
    assert one["recall"] == pytest.approx(2 / 5 * 2 / 3 + 2 / 5)
    claims = {r["query"]: r["true"] for r in compare.claims(table(["abc", "de"]), table(["ab", "c", "de"])).collect()}
    assert claims == {"c0": "c0", "c1": None, "c2": "c1"}
