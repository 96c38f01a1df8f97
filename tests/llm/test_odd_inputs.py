"""Long digit runs, repeated ids of vectors, deep markup and columns whose names hold dots."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import extraction, mixing, privacy, projection, rules  # noqa: E402


@pytest.mark.parametrize("digit", ["0", "1", "9"])
def test_long_digit_runs(spark, digit):
    run = digit * 10_000
    texts = [f"{run}.1.1.1", f"1.{run}.1.1", f"{run} {run}-{run}", f"+{run}", f"+1 {run}", f"a@{run}.{run}", f"{run}@x.y", run]
    ips = {t: [s for s in privacy.base_spans(t) if s[0] == "ip"] for t in texts}
    assert ips[texts[0]] == ([("ip", 0, 10_006)] if digit == "0" else [])
    assert [s for t in texts[2:5] for s in privacy.base_spans(t)] == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert privacy.annotate(docs, keep=["doc_id"]).count() == len(texts)


def test_repeated_and_missing_vector_ids(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(rng.integers(0, 30).item() if rng.random() < 0.95 else None, (base[rng.integers(40)] + 0.03 * rng.standard_normal(16)).astype(np.float32).tolist()) for _ in range(160)]
    rows += [(5, [1.0] + [0.0] * 15), (5, [0.0, 1.0] + [0.0] * 14), (2, [1.0, 0.01] + [0.0] * 14), (3, [0.01, 1.0] + [0.0] * 14)]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    has = np.array([i is not None for i, _ in rows])
    near = (x @ x.T >= 0.95) & has[:, None] & has[None, :]
    np.fill_diagonal(near, False)
    part = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([part[i], *[part[j] for j in np.flatnonzero(near[i])]]) for i in range(len(rows))]
        if new == part:
            break
        part = new
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in set(part) if rows[p][0] is not None}
    want = sorted(((i, int(near[k].sum()), least.get(part[k]), True if i is None else least[part[k]] == i) for k, (i, _) in enumerate(rows)), key=repr)
    got = projection.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == want


def test_deep_markup_is_linear():
    for page in ("<div>x" * 60_000, "<i>" * 60_000 + "</b>" * 60_000, "<i>" * 60_000 + "<li>x" * 60_000, "<div>" * 30_000 + "<head><body>" * 30_000, "<p><i>" * 60_000):
        began = time.time()
        extraction.page_blocks(page)
        assert time.time() - began < 20


def test_columns_with_dots(spark):
    rng = random.Random(2)
    rows = [(i if i % 9 else None, " ".join(rng.choices("some words of a text that goes on".split(), k=70)), "s", 1, "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, row string")
    for table in (docs, docs.limit(0)):
        mixed = mixing.mix_documents(table)
        assert mixed.columns == docs.columns and (mixed.count() > 0) == (table is docs)
        judged = rules.quality_rules(table, spark.createDataFrame([(1,)], "doc_id long"))
        assert judged.columns[:5] == docs.columns and judged.count() == table.count()
