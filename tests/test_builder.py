"""Trimming, moved profiles, graphs of alignments and the store of them."""

from __future__ import annotations

import itertools

import pytest

from graphloom.operators import builder, similarity
from graphloom.sources import store

# Alignments, what is left of the last one, and the trims that leave it.
FIRST = {"A": "MSTGTC-------", "B": "M---TC-------", "C": "M---TC---AILP", "D": "-STP---YWAILP"}
SECOND = FIRST | {"D": "-STPTC-YWAILP"}
LEFT = {"A": "MSTGTC----", "B": "M---TC----", "C": "M---TCAILP", "D": "-STPTCAILP"}


def _aligned(spark, clusters):
    return spark.createDataFrame([(c, i, s) for c, rows in clusters.items() for i, s in rows.items()], "cluster string, id string, seq string")


def _strings(table):
    out = {}
    for r in table.collect():
        out.setdefault(r["cluster"], {})[r["id"]] = r["seq"]
    return out


def test_trims(spark):
    aligned = _aligned(spark, {"x": FIRST, "y": SECOND})
    # in x a string would lose all, in y more than half would go
    assert _strings(builder.trimmed(aligned, [0.3])) == {"x": FIRST, "y": SECOND}
    assert _strings(builder.trimmed(aligned, ["all", 0.3, 0.55, "clean"])) == {"x": {k: v[:6] + v[9:] for k, v in FIRST.items()}, "y": LEFT}
    gaps = {r["pos"]: r["gaps"] for r in similarity.column_gaps(aligned.filter("cluster = 'y'")).collect()}
    assert gaps[0] == 0.25 and gaps[6] == 1.0 and gaps[7] == 0.75


def _profiles(spark, lengths):
    rows = [(i, k, 0.1 * (k % 5), 0.2 + 0.01 * (ord(i) % 7), 0.3 * (k % 2)) for i, n in lengths.items() for k in range(n)]
    return rows, spark.createDataFrame(rows, "id string, indx int, coil_prob double, helix_prob double, sheet_prob double")


def test_profiles_move_to_columns(spark):
    rows, profiles = _profiles(spark, {i: len(s.replace("-", "")) for i, s in SECOND.items()})
    got = {(r["id"], r["indx"]): r["coil_prob"] for r in builder.placed_profiles(profiles, _aligned(spark, {"y": SECOND}), [0.55]).collect()}
    want = {}
    for i, s in SECOND.items():
        own = [r for r in rows if r[0] == i]
        for k, pos in enumerate(p for p, c in enumerate(s) if c != "-"):
            if pos not in (6, 7, 8):
                want[i, pos] = own[k][2]
    assert got == want


def _plain(strings, profiles, matrix):
    """Edges of one cluster in plain Python, from untrimmed columns that all stay."""
    edges = {}
    own = {i: {} for i in strings}
    for i, s in strings.items():
        rows = [r for r in profiles if r[0] == i]
        for k, pos in enumerate(p for p, c in enumerate(s) if c != "-"):
            own[i][pos] = rows[k][2:]
    for a, b in itertools.combinations(sorted(strings), 2):
        x, y, total, before = strings[a], strings[b], 0.0, True
        for c, d in zip(x, y, strict=True):
            gap = "-" in (c, d)
            total += (0.0 if before else -5.0) if gap else matrix[c, d]
            before = gap
        best = [sum(matrix[c, c] for c in s if c != "-") / len(s.replace("-", "")) for s in (x, y)]
        subsmat = sum(total / len(x) / v for v in best) / 2
        shared = own[a].keys() & own[b].keys()
        psi = sum((3 - sum(abs(u - v) for u, v in zip(own[a][k], own[b][k], strict=True))) / 3 for k in shared) / len(own[a].keys() | own[b].keys())
        edges[a, b] = (subsmat, psi)
    low, high = ([f(e[k] for e in edges.values()) for k in (0, 1)] for f in (min, max))
    scaled = lambda e, k: (e[k] - low[k]) / (high[k] - low[k])
    return {p: (*e, 0.3 * e[1] + 0.7 * e[0], 0.3 * scaled(e, 1) + 0.7 * scaled(e, 0)) for p, e in edges.items()}


def test_graphs_and_their_store(spark, tmp_path, monkeypatch):
    strings = {"A": "MSTGTCAILP", "B": "M---TC-IL-", "C": "M-T-TCAILP", "D": "-STPTCAIMP"}
    letters = sorted({c for s in strings.values() for c in s if c != "-"})
    values = {(a, b): (5.0 + ord(a) % 3 if a == b else -1.0 - (ord(a) + ord(b)) % 3) for a in letters for b in letters}
    matrix = spark.createDataFrame([(a, b, v) for (a, b), v in values.items()], "a string, b string, value double")
    rows, profiles = _profiles(spark, {i: len(s.replace("-", "")) for i, s in strings.items()})
    clusters = {"x": strings, "y": {k: strings[k] for k in "ABC"}, "one": {"A": "MSTGTC"}}
    want = {(c, *p): e for c, s in clusters.items() if len(s) > 1 for p, e in _plain(s, rows, values).items()}
    edges = lambda t: {(r["cluster"], r["seq1"], r["seq2"]): tuple(r[k] for k in ("subsmat", "psi", "raw_score", "score")) for r in t.collect()}
    got = edges(builder.graphs(_aligned(spark, clusters), profiles, matrix, ["clean"]))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    path = str(tmp_path / "graphs")
    first = builder.stored_graphs(_aligned(spark, {"x": strings}), profiles, matrix, path, trims=["clean"])
    assert edges(first).keys() == {k for k in want if k[0] == "x"}
    built = []
    graphs = builder.graphs
    monkeypatch.setattr(builder, "graphs", lambda aligned, *a, **b: built.append(sorted({r["cluster"] for r in aligned.collect()})) or graphs(aligned, *a, **b))
    # the second run finds x again under another name, and builds y alone
    again = edges(builder.stored_graphs(_aligned(spark, {"z": strings, "y": clusters["y"]}), profiles, matrix, path, trims=["clean"]))
    assert built == [["y"]] and {(k[0].replace("z", "x"), *k[1:]) for k in again} == want.keys()
    assert all(again[k] == pytest.approx(want["x" if k[0] == "z" else k[0], k[1], k[2]]) for k in again)


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert store.read(spark, path) is None
    rows = lambda *r: spark.createDataFrame(list(r), "hash string, value int")
    # the second writer begins before the first has entered, and enters after it
    read = store.read
    monkeypatch.setattr(store, "read", lambda *a: None)
    store.append(rows(("a", 1), ("b", 1), ("b", 2)), path)
    store.append(rows(("b", 9), ("c", 9), (None, 9)), path)
    monkeypatch.setattr(store, "read", read)
    (tmp_path / "store/tables/unfinished").mkdir()
    found = sorted(map(tuple, store.read(spark, path).collect()))
    assert found == [("a", 1), ("b", 1), ("b", 2), ("c", 9)]
    store.append(rows(("a", 7), ("d", 7)), path)
    assert sorted(map(tuple, store.read(spark, path).collect())) == [*found, ("d", 7)]
    assert [n for n, _ in store.manifests(spark, path)] == [1, 2, 3]
    kept = store.insert_or_ignore(rows(("a", 1)), rows(("a", 2), ("e", 2)))
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("e", 2)]
