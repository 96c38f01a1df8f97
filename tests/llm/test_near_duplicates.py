"""Near duplicates of texts and vectors, and repeated passages, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import chaining, minhash, projection  # noqa: E402

WORDS = ["".join(random.Random(k).choices("abcdefghij", k=5)) for k in range(400)]


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _edited(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def _texts():
    rng = random.Random(5)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(3, 260))) for _ in range(60)]
    base = " ".join(rng.choices(WORDS, k=150))
    out += [_edited(base, rng, k % 7) for k in range(150)]  # many of them link only through others
    out += [base.upper(), base.replace(" ", "\n\t"), "", None, " \n", "one", "One", "two words", "a b c d", "a b c d e", "é a b c d", "É a b c d"]
    out += [" ".join(rng.choices(WORDS, k=30_000)), out[3], out[3]]
    return out


def test_minhash_against_all_pairs(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i * 3, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, band string, id string")
    sets = {i * 3: _shingles(t) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(ids, links)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (None, "d e"), (2, " ")], schema)).collect()
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows)
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True), ("None", "None", True)]


def test_minhash_of_repeated_ids(spark):
    """Every text of a repeated or missing id keeps its links."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=200)) for _ in range(4)]
    near = [_edited(t, rng, 1) for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, near[0]), (3, near[1]), (None, texts[2]), (None, near[3]), (4, near[2]), (5, texts[3]), (5, texts[3]), (None, "x y z")]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, class string, print int")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs).collect())
    want = [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("None", "4"), ("4", "4"), ("None", "5"), ("5", "5"), ("5", "5"), ("None", "None")]
    assert got == sorted((i, c, i == c) for i, c in want)


def test_estimate_follows_similarity(spark):
    rng = random.Random(1)
    base = " ".join(rng.choices(WORDS, k=200))
    texts = [base, _edited(base, rng, 1), _edited(base, rng, 8), " ".join(rng.choices(WORDS, k=200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    signed = docs.withColumn("print", F.lit(0).cast("long")).mapInArrow(minhash._signed, f"id long, print long, {minhash._SIGNED}").select("id", "signature")
    pairs = signed.filter("id = 0").withColumnsRenamed({"id": "a", "signature": "sa"}).join(signed.filter("id > 0").withColumnsRenamed({"id": "b", "signature": "sb"}))
    got = {r["b"]: r["e"] for r in pairs.select("b", minhash.estimated_similarity("sa", "sb").alias("e")).collect()}
    for k in (1, 2, 3):
        true = len(_shingles(texts[0]) & _shingles(texts[k])) / len(_shingles(texts[0]) | _shingles(texts[k]))
        assert abs(got[k] - true) < 0.17


def _vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    rows = [v.tolist() for v in base]
    rows += [(v + rng.normal(scale=0.05, size=16)).tolist() for v in base[:60]]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [1e-300 * x for x in rows[1]]]
    rows += [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    dense = base[7]
    rows += [(dense + rng.normal(scale=0.03, size=16)).tolist() for _ in range(200)]
    return rows


def test_vectors_against_all_pairs(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, class int")
    good = {i: np.array(v) / np.abs(v).max() for i, v in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    want = _components(range(len(rows)), links)
    n = {i: sum(i in p for p in links) for i in range(len(rows))}
    got = projection.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert projection.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = projection.near_vectors(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in rows) == [("5", 1, "5", True), ("5", 1, "5", True), ("None", 0, "None", True)]
    assert projection.passes_for(50_000) <= 24 < projection.passes_for(10**9)


def test_passages(spark):
    rng = random.Random(9)
    rand = lambda n: rng.choices(WORDS, k=n)
    passage = rand(80)
    fuzzy = list(passage)
    fuzzy[30] = "changed"
    fuzzy.insert(55, "added")
    del fuzzy[10]
    short = rand(30)
    texts = {
        1: rand(100) + passage + rand(50), 2: rand(20) + fuzzy + rand(90), 3: rand(300), 4: rand(60) + short + rand(60), 5: rand(40) + short + rand(70),
        6: rand(200) + passage, 8: rand(60),
    }
    texts[9] = texts[8]
    rows = [(i, " ".join(w), 1) for i, w in texts.items()] + [(20, None, 1), (21, "", 1), (22, "few words", 1), (None, "x " * 60, 1), (1, " ".join(texts[1]), 1)]
    found = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, seed int")).collect()
    assert {r["doc_id"] for r in found} | {r["other_id"] for r in found} == {1, 2, 6, 8, 9}
    at = {(r["doc_id"], r["other_id"]): r for r in found}
    assert (at[9, 8]["start_word"], at[9, 8]["end_word"]) == (0, 60)
    whole = at.get((6, 1)) or at[1, 6]
    assert whole["n_equal"] >= 80
    assert any(r["n_equal"] >= 75 and 2 in (r["doc_id"], r["other_id"]) for r in found)
    assert chaining.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_against_quadratic():
    rng = random.Random(4)
    for _ in range(60):
        matches = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        pos, other = [m[0] for m in matches], [m[1] for m in matches]
        best = []
        for i, (p, q) in enumerate(matches):
            gains = [best[j] - chaining.GAP_COST * (p - a + q - b - 2) for j, (a, b) in enumerate(matches[:i]) if a < p and b < q]
            best.append(1 + max([0.0, *gains]))
        score, _ = chaining.best_predecessors(pos, other)
        assert score == pytest.approx(best)
        found = chaining.chains(np.array(pos), np.array(other))
        used = [m for c in found for m in c]
        assert len(used) == len(set(used))
        for chain in found:
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(chain, chain[1:], strict=False))
