"""Whitening against a full eigendecomposition, and the slicing by itself."""

from __future__ import annotations

import math

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, x string, `n.n` long"


@pytest.mark.parametrize("seed", range(20))
def test_pivots_count_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    a = rng.standard_normal((n, n)) * rng.choice([1e-9, 1.0, 1e9])
    a = a + a.T
    if seed % 3 == 0:
        a[np.diag_indices(n)] = 0  # no pivot of one row at first
    assert whitening.positive_pivots(a) == int((np.linalg.eigvalsh(a) > 0).sum())


@pytest.mark.parametrize("values", [[9, 5, 4, 3, 1, 0.1], [5, 5, 5, 2, 1], [7, 7 * (1 - 1e-9), 7 * (1 - 1e-6), 6.9, 1e-3], [3, 0, 0, 0], [1e12, 1.0, 1e-2, 1e-3, 1e-9], [2], [4, 4, 4, 4, 4]])
def test_leading_components(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_components(matrix, 4)
    real = sorted((v for v in values if v > 1e-13 * max(values)), reverse=True)[:4]
    assert np.allclose(found, real, rtol=1e-9, atol=1e-13 * max(values))
    assert np.allclose(vectors @ vectors.T, np.eye(len(real)), atol=1e-12)
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() <= 1e-12 * max(values)


def _plain(rows):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return kept, n, sums, values[::-1][:4], vectors[:, ::-1][:, :4], np.trace(covariance)


def test_against_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[3][1])] * 40 + [(None, rows[5][1]), (900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf, *rows[0][1][1:]]), (904, [-0.0] * 12)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], VECTORS).repartition(5)).collect()
    kept, n, sums, values, vectors, trace = _plain(rows)
    assert len(got) == 4 * len(kept) and {g.n for g in got} == {n} and got[0].identity_error < 1e-9
    white = (np.array([x for _, x in kept]) - sums / n) @ vectors / np.sqrt(values)
    flip = {}
    want = {}
    for (i, x), w in zip(kept, white, strict=True):
        want.setdefault(i, []).append((int(((n * np.array(x) - sums) ** 2).sum()), w))
    for g in sorted(got, key=lambda g: -abs(g.whitened)):
        options = want[g.vec_id]
        sign = flip.setdefault(g.component, math.copysign(1, g.whitened) * math.copysign(1, options[0][1][g.component - 1]) if len(options) == 1 else None)
        if sign is None:
            del flip[g.component]
            continue
        assert any(g.deviation == dev and abs(g.whitened - sign * w[g.component - 1]) < 1e-9 for dev, w in options)
        assert abs(g.explained - values[g.component - 1] / trace) < 1e-12
    assert sorted(g.vec_id is None for g in got).count(True) == 4


def test_low_rank_empty_and_other_dimensions(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], VECTORS)
    assert whitening.whiten(frame([])).collect() == [] and whitening.whiten(frame([(1, []), (2, None)])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    got = whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 3.0]), (4, [1.0])])).collect()
    assert sorted((g.vec_id, g.component) for g in got) == [(1, 1), (2, 1), (3, 1)] and all(abs(g.explained - 1) < 1e-12 for g in got)


def test_deviation_beyond_a_long():
    x = np.array([[2**20, 0], [1, 1]])
    assert whitening._deviations(x, 2**12, [5, 5]) == [None, 2 * (2**12 - 5) ** 2]
