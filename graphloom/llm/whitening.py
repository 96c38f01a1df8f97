"""Whitening of embeddings on their leading principal components, found by slicing the spectrum.

Vectors are taken in whole steps of 1/256.  The fit list holds each distinct vector once;
its sums are exact, its covariance is added up in tasks from centred vectors, block rows
of the matrix meeting by their number, and only the finished matrix (dimension squared)
reaches the driver.

There the eigenvalues are told apart by inertia: by Sylvester's law the pivots of the
LDL' factors of ``covariance - shift * identity`` have as many positive signs as there are
eigenvalues over the shift.  Bisecting on that count isolates the k-th largest eigenvalue
in an interval of its own; Rayleigh quotient iteration converges to it cubically; and the
counts just under and just over what it found certify that it is the k-th.  A search that
left its interval goes on with a narrower one.  The cost is that of some tens of
factorisations, cubic in the dimension and independent of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.staging import drop_staged, stage

STEPS = 256
COMPONENTS = 4
EPS = float(np.finfo(np.float64).eps)
LONG = 2**63

# ---------------------------------------------------------------- the spectrum of a symmetric matrix


def positive_pivots(a: np.ndarray) -> int:
    """The number of positive eigenvalues of a symmetric matrix, by its LDL' factors with pivots of one or two rows."""
    a, n = np.array(a, dtype=np.float64), len(a)
    bound, k, positive = (1 + 17**0.5) / 8, 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most, own, two = (below.max() if len(below) else 0.0), abs(a[k, k]), False
        if max(most, own) == 0:  # an eigenvalue of zero
            k += 1
            continue
        if own < bound * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if own * row.max() < bound * most * most:
                two = abs(a[r, r]) < bound * row.max()
                swap(k + two, r)
        if two:  # such a pair has one eigenvalue of either sign
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            positive += 1
        else:
            c = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            positive += a[k, k] > 0
        k += 1 + two
    return int(positive)


class Slices:
    """How many eigenvalues of a matrix lie over the shifts asked so far."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.known = matrix, {}

    def over(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_pivots(self.matrix - shift * np.eye(len(self.matrix)))
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the k-th largest eigenvalue."""
        return max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k)


def _rayleigh(matrix: np.ndarray, shift: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift``, across the vectors already found."""
    identity, scale = np.eye(len(matrix)), np.abs(matrix).max()
    v = np.random.default_rng(seed).standard_normal(len(matrix))
    best = (np.inf, shift, v)
    for i in range(24):
        v -= found.T @ (found @ v)
        v /= np.linalg.norm(v)
        value = v @ matrix @ v
        left = np.linalg.norm(matrix @ v - value * v)
        if i > 2 and left >= best[0] and best[0] <= 64 * len(matrix) * EPS * scale:
            break
        best = min(best, (left, value, v), key=lambda x: x[0])
        at = shift if i < 3 else value  # a few steps with the shift held, so that the nearest eigenvalue leads
        try:
            v = np.linalg.solve(matrix - at * identity, v)
        except np.linalg.LinAlgError:
            v = np.linalg.solve(matrix - (at + 4 * EPS * scale) * identity, v)
    return best[1], best[2]


def leading_components(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues and their unit vectors (rows), fewer where the others are zero up to rounding."""
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((0, d))
    slices, near = Slices(matrix), 16 * d * EPS * top
    slices.over(top + near)
    values, vectors = [], np.zeros((0, d))
    for k in range(1, min(count, slices.over(near)) + 1):
        while True:
            low, high = slices.around(k)
            alone = slices.over(low) - slices.over(high) == 1
            if alone or high - low <= near:
                value, vector = _rayleigh(matrix, (low + high) / 2, vectors, k)
                certain = low <= value <= high and slices.over(value - near) >= k > slices.over(value + near)
                if certain or high - low <= near:
                    break
            slices.over((low + high) / 2)
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


# ---------------------------------------------------------------- sums in tasks


def whole_steps(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Id and ``x``, the vector in whole steps; without vectors that are null, or hold nulls or what is no finite number of steps."""
    fits = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**54))
    steps = F.transform(vec_col, lambda c: F.floor(c.cast("double") * STEPS))
    return df.filter(F.col(vec_col).isNotNull() & fits).select(F.col(id_col).alias("vec_id"), steps.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            exact = x if len(x) * int(np.abs(x).max(initial=0)) < LONG else x.astype(object)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "total"])

    rows = fit.mapInArrow(work, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r.i: int(r.total) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows[i] = rows.get(i, 0) + values.values.to_numpy()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "row"])


def centred_products(fit: DataFrame, mean: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
    """The sum over ``fit`` of the products of centred vectors with themselves; with ``to``, of their projections.

    A task holds one matrix, and gives its rows; rows of one number meet in one task, a
    running sum each, so neither grows with the number of tasks.
    """
    d = len(mean)
    k = d if to is None else to.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = _matrix(batch.column(0), d) - mean
            z = z if to is None else z @ to
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    schema = "i int, row array<double>"
    rows = fit.mapInArrow(work, schema).repartition("i").mapInArrow(_summed_rows, schema).collect()
    total = np.zeros((k, k))
    for r in rows:
        total[r.i] = r.row
    return (total + total.T) / 2


# ---------------------------------------------------------------- whitening


@dataclass
class Whitening:
    """What the fit list gave: ``n``, sums and the components (rows of ``vectors``)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """From a centred vector to its whitened components."""
        return self.vectors.T / np.sqrt(self.values)


def fit_whitening(x: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit on each distinct vector of ``x`` once; ``d``: their dimension."""
    fit = stage(x.select("x").distinct(), "fit")
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    covariance = centred_products(fit, mean) / n
    values, vectors = leading_components(covariance, components)
    model = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    if len(values):
        model.identity_error = float(np.abs(centred_products(fit, mean, model.projection) / n - np.eye(len(values))).max())
    drop_staged(fit)
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of ``(n * x - S)^2`` of each row; null where no long holds it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most * most < LONG:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < LONG else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    Vectors that are null or hold nulls or non-finite entries have no rows (nor have those
    with an entry of 2^54 or more).  Vectors of another dimension than the commonest (of
    equally common ones the largest) have none either.  Repeated rows and rows without an
    id are whitened each; repeated vectors count once in the fit.  There are fewer
    components where the fit list has a lower rank, none where all vectors are equal, and
    an empty table gives an empty result.  ``deviation`` is null where no long holds it.
    Other columns do not matter.
    """
    spark, x = df.sparkSession, whole_steps(df, id_col, vec_col)
    schema = T.StructType([T.StructField("vec_id", x.schema["vec_id"].dataType)]).add("component", T.IntegerType()).add("deviation", T.LongType()).add("whitened", T.DoubleType())
    out = lambda rows, n, explained, error: rows.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("component")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
    dims = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims.d if dims else 0
    x = x.filter(F.size("x") == d)
    model = fit_whitening(x, d, components) if d else None
    if model is None or not len(model.values):
        return out(spark.createDataFrame([], schema), 0, [0.0], 0.0)
    mean, projection, n, sums = model.mean, model.projection, model.n, model.sums
    k = len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), d)
            rows = np.repeat(np.arange(len(v)), k)
            arrays = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                pa.array(_deviations(v, n, sums), pa.int64()).take(pa.array(rows)), pa.array(((v - mean) @ projection).ravel()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "deviation", "whitened"])

    return out(x.mapInArrow(work, schema), n, model.values / model.trace, model.identity_error)
