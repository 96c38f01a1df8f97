"""Near vectors inside a dense region."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import projection  # noqa: E402


def test_dense_region(spark):
    """Links among vectors that are all close to each other are found although windows fill with others."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    off = np.linalg.qr(np.concatenate([centre[:, None], rng.normal(size=(64, 63))], axis=1))[0][:, 1:]
    side = rng.normal(size=(1000, 63))
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = side + 0.9 * rng.normal(size=side.shape) / np.sqrt(63)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    x = np.concatenate([np.sqrt(0.85) * centre + np.sqrt(0.15) * (s @ off.T) for s in (side, near)])
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    assert links.sum() > 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in sorted(projection.near_vectors(df, window=8).collect())])
    assert got.sum() >= 0.995 * links.sum(), got.sum() / links.sum()


def _planted(n, pairs, seed):
    """Vectors of 32 dimensions, the first ``pairs`` of which have a partner at cosine 0.951 to 0.96 at the end."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, 32))
    side -= np.einsum("ij,ij->i", side, x[:pairs])[:, None] * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.96, size=(pairs, 1))
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c * c) * side])


@pytest.mark.parametrize("partitions", [2, 60])
def test_windows_cross_ranges(spark, partitions):
    """Pairs are found whatever the number of ranges, ranges shorter than a window among them."""
    x = _planted(1500, 150, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in projection.near_vectors(df, passes=16, quiet_jobs=0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {i: (i % 1500, int(i < 150 or i >= 1500)) for i in range(1650)}
