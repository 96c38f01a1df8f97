"""Collapsing in parts against the plain ordered walk."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.jobs import catalog
from graphloom.operators import similarity
from graphloom.operators.collapse import collapsed, collapsed_vectors


def _walk(taxon, edges):
    """Every id in order, until nothing changes, over the whole graph."""
    near = {i: {} for i in taxon}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w

    def tops(i):
        best = max(near[i].values(), default=None)
        return [j for j in sorted(near[i]) if near[i][j] == best]

    held, changed = {i: [i] for i in taxon}, True
    while changed:
        changed = False
        for i in sorted(taxon):
            if i not in held:
                continue
            hits = tops(i)
            if any(taxon[j] != taxon[i] for j in hits):
                continue
            for j in hits:
                if i in tops(j):
                    held[i] += held.pop(j)
                    for k in near.pop(j):
                        near[k].pop(j)
                    changed = True
    return {i: r for r, ids in held.items() for i in ids}


def _graph(rng, g, n, taxa, density, levels):
    ids = [f"{g}{k:03d}" for k in rng.permutation(n)]
    taxon = {i: f"t{rng.integers(taxa)}" for i in ids}
    edges = []
    for x in range(n):
        for y in range(x + 1, n):
            if rng.random() < density:
                bonus = 1 if taxon[ids[x]] == taxon[ids[y]] else 0
                edges.append((ids[x], ids[y], float(rng.integers(levels)) + bonus * float(rng.integers(0, 3))))
    return taxon, edges


def _compare(spark, graphs, **more):
    members = spark.createDataFrame([(g, i, t) for g, (taxon, _) in graphs.items() for i, t in taxon.items()], "cluster string, id string, taxon string")
    edges = spark.createDataFrame([(g, a, b, w) for g, (_, e) in graphs.items() for a, b, w in e], "cluster string, seq1 string, seq2 string, score double")
    got = {(r["cluster"], r["id"]): r["rep"] for r in collapsed(edges, members, **more).collect()}
    want = {(g, i): r for g, (taxon, e) in graphs.items() for i, r in _walk(taxon, e).items()}
    assert got == want
    return sum(i != r for (_, i), r in want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    graphs = {}
    for k in range(60):
        n, taxa = int(rng.integers(1, 26)), int(rng.integers(1, 6))
        graphs[f"g{k}"] = _graph(rng, f"g{k}-", n, taxa, rng.choice([0.15, 0.5, 1.0]), int(rng.choice([2, 6, 100])))
    assert _compare(spark, graphs) > 100


def test_walk_as_a_table(spark):
    rng = np.random.default_rng(4)
    graphs = {f"g{k}": _graph(rng, f"g{k}-", int(rng.integers(2, 9)), 2, 0.7, 4) for k in range(12)}
    assert _compare(spark, graphs, limit=0) > 8


def test_one_taxon_chain_and_hub(spark):
    hub = ({f"h{k:03d}": "t" for k in range(60)}, [("h000", f"h{k:03d}", 5.0) for k in range(1, 60)])
    chain = ({f"c{k:03d}": "t" for k in range(12)}, [(f"c{k:03d}", f"c{k + 1:03d}", float(12 - k)) for k in range(11)])
    lone = ({"l1": "t", "l2": "u"}, [])
    assert _compare(spark, {"hub": hub, "chain": chain, "lone": lone}) > 59


def test_vectors_collapse_as_their_edges_do(spark):
    """Rounds over pairs made anew against the table of all edges; near copies, ties, lone, zero and missing vectors, a null taxon."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 5))
    rows = []
    for k in range(160):
        near = base[k % 40] + (0 if k % 3 == 0 else rng.normal(size=5) * 0.1)
        taxon = None if k % 40 == 7 else (k % 40) % 4 if rng.random() < 0.8 else int(rng.integers(4))
        rows.append((k % 3, k, taxon, [float(v) for v in near]))
    rows += [(5, 900, 1, [1.0] * 5), (0, 901, 2, None)]
    vectors = spark.createDataFrame(rows, "cluster int, id int, taxon int, vec array<double>").repartition(3)
    raw = F.round(similarity.PROFILE_SHARE * F.col("psi") + similarity.MATRIX_SHARE * F.col("subsmat"), 9).alias("score")
    edges = similarity.vector_pairs(vectors, by="cluster").select("cluster", "seq1", "seq2", raw)
    groups = lambda t: {(r["cluster"], r["id"]): r["rep"] for r in t.collect()}
    want = groups(collapsed(edges, vectors.select("cluster", "id", "taxon")))
    assert groups(collapsed_vectors(vectors, block=16)) == want and sum(i != r for (_, i), r in want.items()) > 20


def test_the_query_writes_no_table_of_pairs(spark, monkeypatch, tmp_path):
    def made(*_, **__):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(similarity, "vector_pairs", made)
    spark.createDataFrame([(k, [1.0, float(k // 14)], 0) for k in range(28)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r["id"], r["rep"]) for r in catalog.QUERIES["collapsed_paralogs"](spark, str(tmp_path)).collect()} == {(k, k % 7) for k in range(28)}
