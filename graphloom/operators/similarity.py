"""All-by-all similarity graphs: pairs of vectors, aligned strings and profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.columns import min_max
from graphloom.functions.staging import stage

#: The least rows of a block, and the rows of a part that is multiplied at once.
BLOCK, TILE = 64, 1024
#: Blocks that a table is dealt to on any number of cores, until each has this many rows.
MOST_BLOCKS, MOST_ROWS = 24, 65_536
#: Twice the pairs of blocks that every core gets.
SHARE = 6
#: Raw scores are rounded to nine places before they are compared; pairs that a task holds before it drops those that are not best.
SLACK, MOST_FOUND = 2e-9, 1 << 21
#: Rounded scores, as whole numbers, are counted by their bits above these; all lie within two to the thirtieth.
BIN_BITS, SCORE_BITS = 18, 30
GAP_OPEN, GAP_EXTEND = -5.0, 0.0
PROFILE_SHARE, MATRIX_SHARE = 0.3, 0.7


def most_blocks(spark: SparkSession) -> int:
    """As many blocks as make some three pairs of blocks for every core."""
    return min(MOST_BLOCKS, math.ceil(math.sqrt(SHARE * spark.sparkContext.defaultParallelism)))


def block_count(spark: SparkSession, n: int, block: int, most_rows: int = MOST_ROWS) -> int:
    """Blocks that ``n`` rows are dealt to: see :func:`block_pairs`."""
    return max(1, min(-(-n // block), most_blocks(spark)), -(-n // most_rows))


def block_pairs(rows: DataFrame, block: int, by: str | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """``rows`` with ``i, j, at``: dealt to blocks ``at`` by ``id``, each row once for every block it meets, as pairs i <= j of blocks.

    There are some three pairs of blocks for every core, whatever the number of rows, as each
    row is copied once for each block: the copies grow like the rows do.  Only where blocks
    would have less than ``block`` rows there are fewer, and more where they would have over
    ``most_rows``, so from as many rows for every block on.  With ``by``, each group of rows by itself.
    """
    if by is None:
        count = F.lit(block_count(rows.sparkSession, rows.count(), block, most_rows))
    else:
        n = F.count("*")
        rows = rows.join(rows.groupBy(by).agg(F.greatest(F.least(F.ceil(n / block), F.lit(most_blocks(rows.sparkSession))), F.ceil(n / most_rows)).alias("blocks")), by)
        count = F.col("blocks")
    dealt = rows.withColumn("at", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))
    return dealt.withColumn("i", F.least("at", "k")).withColumn("j", F.greatest("at", "k")).drop("k", "blocks")


def sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of block i and those of block j of a pair of blocks."""
    return rows[rows["at"] == rows["i"]], rows[rows["at"] == rows["j"]]


def tiles(n_left: int, n_right: int, same: bool, tile: int = TILE) -> Iterator[tuple[slice, slice, bool]]:
    """Parts of two blocks that meet, and whether both are one part; of a block with itself, each two parts once."""
    for a in range(0, n_left, tile):
        for b in range(a if same else 0, n_right, tile):
            yield slice(a, a + tile), slice(b, b + tile), same and a == b


def paired(left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which rows of two parts are pairs: different ids, inside one part once."""
    return left[:, None] < right[None, :] if same else left[:, None] != right[None, :]


def grouped_blocks(rows: DataFrame, block: int, by: str | None, run: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """What ``run`` gives for every pair of blocks, part by part; with ``by``, a column of that name is in front."""
    keys = ["i", "j"] if by is None else [by, "i", "j"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(batches), ignore_index=True)  # two blocks
        for part in run(met):
            if by is not None:
                part.insert(0, by, pd.Series([met[by].iloc[0]] * len(part), index=part.index, dtype=object))
            yield part

    each.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    if by is not None:
        schema = f"`{by}` {rows.schema[by].dataType.simpleString()}, {schema}"
    return block_pairs(rows, block, by, most_rows).groupBy(*keys).applyInPandas(each, schema)


class _Blocks:
    """Two blocks of vectors and the scores of their parts."""

    def __init__(self, rows: pd.DataFrame):
        left, right = sides(rows)
        self.same = bool((rows["i"] == rows["j"]).all())
        self.ids = left["id"].to_numpy(), right["id"].to_numpy()
        self.empty = left.empty or right.empty
        if not self.empty:
            self.x, self.y = (np.stack(part["vec"].to_numpy()).astype(float) for part in (left, right))
            self.xx, self.yy = (self.x * self.x).sum(axis=1), (self.y * self.y).sum(axis=1)

    def parts(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        if not self.empty:
            for a, b, one in tiles(len(self.x), len(self.y), self.same):
                yield a, b, paired(self.ids[0][a], self.ids[1][b], one)

    def cosine(self, a: slice, b: slice) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.x[a] @ self.y[b].T) / np.sqrt(self.xx[a][:, None] * self.yy[b][None, :])

    def psi_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of single pairs, in pieces of bounded size."""
        out = np.empty(len(a))
        for k in range(0, len(a), 1 << 16):
            apart = self.x[a[k : k + (1 << 16)]] - self.y[b[k : k + (1 << 16)]]
            out[k : k + (1 << 16)] = 1 / (1 + np.sqrt(np.maximum(0, (apart * apart).sum(axis=1))))
        return out

    def psi(self, a: slice, b: slice) -> np.ndarray:
        """Of all pairs of two parts: from the products, but from the differences where these would cancel."""
        sizes = self.xx[a][:, None] + self.yy[b][None, :]
        square = sizes - 2 * (self.x[a] @ self.y[b].T)
        with np.errstate(invalid="ignore"):
            close = ~(square >= 0.05 * sizes)
            out = 1 / (1 + np.sqrt(np.maximum(0, square)))
        i, j = np.nonzero(close)
        out[i, j] = self.psi_of(i + a.start, j + b.start)
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, psi: np.ndarray) -> pd.DataFrame:
        left, right = self.ids[0][i], self.ids[1][j]
        return pd.DataFrame({"seq1": np.minimum(left, right), "seq2": np.maximum(left, right), "subsmat": cosine, "psi": psi})


def _pair_scores(least: float | None):
    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(rows)
        for a, b, wanted in blocks.parts():
            cosine = blocks.cosine(a, b)
            if least is not None:
                wanted &= cosine >= least
            i, j = np.nonzero(wanted)
            psi = blocks.psi(a, b)[i, j] if least is None else blocks.psi_of(i + a.start, j + b.start)
            yield blocks.pairs(i + a.start, j + b.start, cosine[i, j], psi)

    return run


def _marked_scores(least: float | None):
    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(rows)
        marks = [part["mark"].to_numpy(dtype=bool) for part in sides(rows)]
        for a, b, wanted in blocks.parts():
            cosine = blocks.cosine(a, b)
            wanted &= marks[0][a][:, None] | marks[1][b][None, :]
            if least is not None:
                wanted &= cosine >= least
            i, j = np.nonzero(wanted)
            value, i, j = cosine[i, j], i + a.start, j + b.start
            found, first = blocks.pairs(i, j, value, blocks.psi_of(i, j)), blocks.ids[0][i] < blocks.ids[1][j]
            yield found.assign(mark1=np.where(first, marks[0][i], marks[1][j]), mark2=np.where(first, marks[1][j], marks[0][i]))

    return run


def half_up(values: np.ndarray, places: int) -> np.ndarray:
    """Whole numbers of ``10 ^ -places``, halves away from zero, as Spark's ``round`` has them: by the shortest decimal form of a value."""
    scaled = np.abs(values) * 10.0**places
    low = np.floor(scaled)
    out = np.floor(scaled + 0.5)
    for k in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-5).tolist():  # too near to a half for a product in doubles
        out[k] = int(Decimal(repr(float(abs(values[k])))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, values)


def _kept_scores(threshold: float):
    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(rows)
        for a, b, wanted in blocks.parts():
            raw = PROFILE_SHARE * blocks.psi(a, b) + MATRIX_SHARE * blocks.cosine(a, b)
            i, j = np.nonzero(wanted)
            nine = half_up(raw[i, j], 9)
            six = np.copysign(np.floor((np.abs(nine) + 500) / 1000), nine) / 1e6
            left, right = blocks.ids[0][i + a.start], blocks.ids[1][j + b.start]
            score = np.where(nine / 1e9 > threshold, six, 0.0)  # a score that is none is not over it
            yield pd.DataFrame({"seq1": np.minimum(left, right), "seq2": np.maximum(left, right), "raw_score": score})

    return run


def _best_scores(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The pairs of two blocks that may be the best of either end: those whose raw score is within ``SLACK`` of the best that either has there."""
    blocks = _Blocks(rows)
    if blocks.empty:
        return
    best = [np.full(len(ids), -np.inf) for ids in blocks.ids]
    if blocks.same:
        best[1] = best[0]  # one block's rows are on both sides
    found: list[tuple[np.ndarray, ...]] = []

    def kept() -> tuple[np.ndarray, ...]:
        i, j, raw, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
        good = (raw >= best[0][i] - SLACK) | (raw >= best[1][j] - SLACK)
        return tuple(c[good] for c in (i, j, raw, *rest))

    for a, b, wanted in blocks.parts():
        cosine, psi = blocks.cosine(a, b), blocks.psi(a, b)
        raw = PROFILE_SHARE * psi + MATRIX_SHARE * cosine
        wanted &= ~np.isnan(raw)  # a score that is none reaches Spark as null
        raw = np.where(wanted, raw, -np.inf)
        best[0][a] = np.maximum(best[0][a], raw.max(axis=1))
        best[1][b] = np.maximum(best[1][b], raw.max(axis=0))
        i, j = np.nonzero(wanted & ((raw >= best[0][a][:, None] - SLACK) | (raw >= best[1][b][None, :] - SLACK)))
        found.append((i + a.start, j + b.start, raw[i, j], cosine[i, j], psi[i, j]))
        if sum(len(f[0]) for f in found) > MOST_FOUND:
            i, j, raw, cosine, psi = kept()
            found = [(i, j, raw, cosine, psi)]
            if len(i) > MOST_FOUND // 2:  # ties: they go out as they are
                yield blocks.pairs(i, j, cosine, psi)
                found = []
    if found:
        i, j, _, cosine, psi = kept()
        yield blocks.pairs(i, j, cosine, psi)


def _extremes(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The extremes of both scores of the pairs of two blocks; a score that is none has no part."""
    blocks = _Blocks(rows)
    for a, b, wanted in blocks.parts():
        if wanted.any():
            ends = {}
            for name, values in (("psi", blocks.psi(a, b)[wanted]), ("subsmat", blocks.cosine(a, b)[wanted])):
                ends[f"low_{name}"], ends[f"high_{name}"] = [np.fmin.reduce(values)], [np.fmax.reduce(values)]
            yield pd.DataFrame(ends)


def _counts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    blocks = _Blocks(rows)
    yield pd.DataFrame({"pairs": [sum(int(wanted.sum()) for _, _, wanted in blocks.parts())]})


def _rounded_scores(blocks: _Blocks) -> Iterator[tuple[np.ndarray, int]]:
    """Raw scores of each part of two blocks as whole numbers of ``1e-9``, those that are none left out, and how many pairs the part has."""
    for a, b, wanted in blocks.parts():
        raw = (PROFILE_SHARE * blocks.psi(a, b) + MATRIX_SHARE * blocks.cosine(a, b))[wanted]
        yield half_up(raw[~np.isnan(raw)], 9).astype(np.int64), len(raw)


def _score_counts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of two blocks: number, mean and summed squared distance from it of their scores, and how many fall into each bin."""
    n, mean, apart, pairs, counts = 0, 0.0, 0.0, 0, np.zeros(2 << (SCORE_BITS - BIN_BITS), dtype="<i8")
    for k, met in _rounded_scores(_Blocks(rows)):
        pairs += met
        if len(k):
            v = k / 1e9
            n, mean, apart = _merged((n, mean, apart), (len(k), float(v.mean()), float(((v - v.mean()) ** 2).sum())))
            counts += np.bincount((k + (1 << SCORE_BITS)) >> BIN_BITS, minlength=len(counts))
    if pairs:
        yield pd.DataFrame({"n": [n], "mean": [mean], "apart": [apart], "counts": [counts.tobytes()]})


def _merged(one: tuple[int, float, float], other: tuple[int, float, float]) -> tuple[int, float, float]:
    """Number, mean and summed squared distance of two sets of values together."""
    n, step = one[0] + other[0], other[1] - one[1]
    return n, one[1] + step * other[0] / max(n, 1), one[2] + other[2] + step * step * one[0] * other[0] / max(n, 1)


def _score_values(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The scores in the bins that are asked for, each once with how often it comes."""
    bins, found = np.asarray(rows["bins"].iloc[0], dtype=np.int64), {}
    for k, _ in _rounded_scores(_Blocks(rows)):
        values, n = np.unique(k[np.isin((k + (1 << SCORE_BITS)) >> BIN_BITS, bins)], return_counts=True)
        for v, c in zip(values.tolist(), n.tolist(), strict=True):
            found[v] = found.get(v, 0) + c
    yield pd.DataFrame({"value": list(found), "n": list(found.values())}, dtype=np.int64)


def score_ranges(vectors: DataFrame, by: str, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``by, n, spread, low, high`` of the rounded raw scores of all pairs in each group: number, sample variance and two percentiles, between neighbours linearly.

    No pair leaves the task that makes it.  Tasks count scores by bins; pairs are then made once more
    and the values in the bins that hold the percentiles are counted one by one, of which a bin has a bounded number.
    """
    own, shares = _usable(vectors, by), (low / 100, high / 100)
    counted = stage(grouped_blocks(own, block, by, _score_counts, "n long, mean double, apart double, counts binary"), "counts")
    kind = vectors.schema[by].dataType.simpleString()

    def ends(n: int) -> list[int]:
        return sorted({f(p * (n - 1)) for p in shares for f in (math.floor, math.ceil)})

    def total(key, rows: pd.DataFrame) -> pd.DataFrame:
        n, _, apart = reduce(_merged, zip(rows["n"].tolist(), rows["mean"].tolist(), rows["apart"].tolist(), strict=True))
        upto = np.cumsum(sum(np.frombuffer(c, "<i8") for c in rows["counts"]))
        bins = sorted({int(np.searchsorted(upto, r, side="right")) for r in ends(n)}) if n else []
        ahead = [int(upto[b - 1]) if b else 0 for b in bins]
        return pd.DataFrame({by: [key[0]], "total": [n], "spread": [apart / (n - 1) if n > 1 else None], "bins": [bins], "ahead": [ahead]})

    whole = stage(counted.groupBy(by).applyInPandas(total, f"`{by}` {kind}, total long, spread double, bins array<int>, ahead array<long>"), "ranges")
    met = grouped_blocks(own.join(whole.select(by, "bins"), by), block, by, _score_values, "value long, n long")
    values = met.groupBy(by, "value").agg(F.sum("n").alias("times"))

    def placed(key, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        n, rows = int(first["total"]), rows.dropna(subset=["value"]).sort_values("value")
        at, out = {}, []
        for b, ahead in zip(first["bins"], first["ahead"], strict=True):
            own = rows[(rows["value"].astype(np.int64) + (1 << SCORE_BITS)) // (1 << BIN_BITS) == b]
            upto, values = ahead + own["times"].cumsum().to_numpy(), own["value"].to_numpy()
            at |= {r: int(values[np.searchsorted(upto, r, side="right")]) / 1e9 for r in ends(n) if ahead <= r < upto[-1]}
        for p in shares if n else ():
            place = p * (n - 1)
            x, y = at[math.floor(place)], at[math.ceil(place)]
            out.append(x if x == y else (math.ceil(place) - place) * x + (place - math.floor(place)) * y)
        x, y = out or (None, None)
        return pd.DataFrame({by: [key[0]], "n": [n], "spread": [first["spread"]], "low": [x], "high": [y]})

    return whole.join(values, by, "left").groupBy(by).applyInPandas(placed, f"`{by}` {kind}, n long, spread double, low double, high double")


def usable_vector(column: str = "vec") -> Column:
    """Whether a row has a vector, without a null in it."""
    return F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull())


def _usable(vectors: DataFrame, by: str | None) -> DataFrame:
    rows = vectors.select("id", "vec", *([by] if by else [])).filter(usable_vector())
    return rows.filter(F.col(by).isNotNull()) if by else rows


def _edge_schema(vectors: DataFrame) -> str:
    kind = vectors.schema["id"].dataType.simpleString()
    return f"seq1 {kind}, seq2 {kind}, subsmat double, psi double"


def vector_pairs(vectors: DataFrame, least: float | None = None, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """``seq1 < seq2, subsmat, psi`` of all pairs of rows ``id, vec`` (of those at cosine ``least`` or more).

    ``subsmat`` is the cosine, ``psi`` one over one plus the distance.  Rows are dealt to
    blocks, and each task multiplies one block with another, each two blocks once and a part
    of ``TILE`` rows at a time, so no task sees more than two blocks whatever the number of
    rows, and pairs under the bound never leave it.  Rows without a vector, or with a null in
    it, have no pairs.  With ``by``, only rows of one group meet, and its column is in front.
    """
    return grouped_blocks(_usable(vectors, by), block, by, _pair_scores(least), _edge_schema(vectors))


def kept_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``seq1 < seq2, raw_score`` of all of :func:`vector_pairs`, scores that are not over the threshold 0.

    Scores are rounded to nine places before they are compared and to six after, in the tasks
    that make the pairs, where numpy does it; a hundred million times, Spark's ``round`` costs more than the pairs.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    return grouped_blocks(_usable(vectors, None), block, None, _kept_scores(threshold), f"seq1 {kind}, seq2 {kind}, raw_score double")


def marked_pairs(vectors: DataFrame, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """Those of :func:`vector_pairs` of which an end has ``mark``, and ``mark1, mark2`` of their ends; no other pair leaves its task, and none is joined."""
    marks = vectors.select("id", F.coalesce("mark", F.lit(False)).alias("mark"), "vec").filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull()))
    return grouped_blocks(marks, block, None, _marked_scores(least), f"{_edge_schema(vectors)}, mark1 boolean, mark2 boolean")


def best_pairs(vectors: DataFrame, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """Those of :func:`vector_pairs` that can be a best hit of either end by raw score, ties and near ties all kept, and some that are not.

    A task keeps what is best for a row among the pairs of its two blocks, so a row has a few
    pairs for every block, and no table of all pairs is written; best hits of these pairs are
    those of all.
    """
    return grouped_blocks(_usable(vectors, by), block, by, _best_scores, _edge_schema(vectors))


def pair_extremes(vectors: DataFrame, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """``low_psi, high_psi, low_subsmat, high_subsmat`` of all pairs, or of those of each group, taken inside the tasks."""
    schema = "low_psi double, high_psi double, low_subsmat double, high_subsmat double"
    found = grouped_blocks(_usable(vectors, by), block, by, _extremes, schema)
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in ("low_psi", "high_psi", "low_subsmat", "high_subsmat")]
    return found.groupBy(*([by] if by else [])).agg(*ends)


def pair_count(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row, ``pairs``: the pairs that the tasks of :func:`vector_pairs` come upon, counted there."""
    return grouped_blocks(_usable(vectors, None), block, None, _counts, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("pairs"))


def with_final_scores(pairs: DataFrame, by: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Pairs with ``raw_score`` before and ``score`` after min-max scaling of both parts, over the graph or each of ``by``.

    The extremes are an aggregate joined back, not a window, so a graph's edges need not
    meet in one task; without ``by`` they are one row.  Where they are ``known`` already (see
    :func:`pair_extremes`), the pairs are read once.
    """
    raw = (PROFILE_SHARE * F.col("psi") + MATRIX_SHARE * F.col("subsmat")).alias("raw_score")
    ends = [f(c).alias(f"{n}_{c}") for c in ("psi", "subsmat") for n, f in (("low", F.min), ("high", F.max))]
    keys = by or ["_all"]
    keyed = pairs if by else pairs.withColumn("_all", F.lit(1))
    found = keyed.groupBy(*keys).agg(*ends) if known is None else known if by else known.withColumn("_all", F.lit(1))
    joined = keyed.join(found if by else F.broadcast(found), keys)  # one row without ``by``
    scaled = {c: min_max(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")) for c in ("psi", "subsmat")}
    score = (PROFILE_SHARE * scaled["psi"] + MATRIX_SHARE * scaled["subsmat"]).alias("score")
    return joined.select(*pairs.columns, raw, score)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: ``src, dst`` and the other columns."""
    rest = [c for c in edges.columns if c not in ("seq1", "seq2")]
    there = edges.select(F.col("seq1").alias("src"), F.col("seq2").alias("dst"), *rest)
    return there.unionByName(edges.select(F.col("seq2").alias("src"), F.col("seq1").alias("dst"), *rest))


def residues(aligned: DataFrame) -> DataFrame:
    """Long form of ``id, seq``: ``id, pos, residue``, positions from 0."""
    return aligned.select("id", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "residue"))


def _walked(values: dict[tuple[str, str], float], gap_open: float, gap_extend: float, gap: str):
    """Scores of Arrow rows ``pair, seq1, seq2``; single letters of the matrix are looked up by code point."""
    letters = sorted({c for pair in values for c in pair if len(c) == 1})
    points = np.array([ord(c) for c in letters] or [-1], dtype=np.int64)
    place = {c: k for k, c in enumerate(letters)}
    table = np.zeros((len(points) + 1, len(points) + 1))  # the last place: unknown letters
    for (x, y), value in values.items():
        if x in place and y in place:
            table[place[x], place[y]] = value

    def places(text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(points, codes), len(points) - 1)
        return np.where(points[at] == codes, at, len(points)), codes == ord(gap)

    def score(one: str | None, other: str | None) -> float | None:
        if not one or not other or len(one) != len(other):
            return None
        (x, x_gap), (y, y_gap) = places(one), places(other)
        gapped = x_gap | y_gap
        before = np.concatenate(([True], gapped[:-1]))
        cost = np.where(gapped, np.where(before, gap_extend, gap_open), table[x, y])
        seen, ratios = np.cumsum(cost)[-1] / len(cost), []  # one after the other, as the sum is defined
        for z, none in ((x, x_gap), (y, y_gap)):
            n, own = int((~none).sum()), float(np.cumsum(np.where(none, 0.0, table[z, z]))[-1])
            if not n or not own:
                return None
            ratios.append(seen / (own / n))
        return float(ratios[0] + ratios[1]) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(x.as_py(), y.as_py()) for x, y in zip(batch.column("seq1"), batch.column("seq2"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(found, pa.float64())], ["pair", "score"])

    return run


def alignment_scores(pairs: DataFrame, matrix: DataFrame, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND, gap: str = "-") -> DataFrame:
    """``pair, score`` of each pair of equally long gapped strings.

    ``pairs`` has ``pair, seq1, seq2``; ``matrix`` has ``a, b, value`` for ordered pairs of
    residues.  A column with a gap costs ``gap_open`` where the column before had none and
    ``gap_extend`` elsewhere, so a leading gap extends.  The sum per column is set against
    each string's score with itself, and both ratios are averaged.  Each pair is one walk
    over its two strings, as arrays of code points; nothing is shuffled.  The matrix, an
    alphabet squared, is a constant of the tasks.
    """
    given = matrix.select("a", "b", F.col("value").cast("double").alias("value")).filter("a is not null and b is not null and value is not null")
    values = {(r["a"], r["b"]): r["value"] for r in given.collect()}  # residues squared
    kind = pairs.schema["pair"].dataType.simpleString()
    return pairs.select("pair", "seq1", "seq2").mapInArrow(_walked(values, float(gap_open), float(gap_extend), gap), f"pair {kind}, score double")


def profile_scores(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``seq1, seq2, psi``: agreement of secondary-structure profiles matched on their index.

    ``profiles`` has ``id, indx, coil_prob, helix_prob, sheet_prob``.  Each shared index
    adds (3 - the three absolute differences) / 3; the sum is divided by the number of
    indexes that either has, which counts give without an outer join of the rows.
    """
    p = ["coil_prob", "helix_prob", "sheet_prob"]
    left = profiles.select(F.col("id").alias("seq1"), "indx", *[F.col(c).alias(f"x_{c}") for c in p])
    right = profiles.select(F.col("id").alias("seq2"), "indx", *[F.col(c).alias(f"y_{c}") for c in p])
    shared = pairs.select("seq1", "seq2").join(left, "seq1").join(right, ["seq2", "indx"])
    apart = sum((F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) for c in p), F.lit(0.0))
    sums = shared.groupBy("seq1", "seq2").agg(F.sum((3 - apart) / 3).alias("total"), F.count("*").alias("n"))
    sizes = profiles.groupBy("id").agg(F.count("*").alias("size"))
    counted = (
        pairs.select("seq1", "seq2").join(sums, ["seq1", "seq2"], "left")
        .join(sizes.select(F.col("id").alias("seq1"), F.col("size").alias("size_1")), "seq1", "left")
        .join(sizes.select(F.col("id").alias("seq2"), F.col("size").alias("size_2")), "seq2", "left").fillna(0)
    )
    return counted.select("seq1", "seq2", F.try_divide("total", F.col("size_1") + F.col("size_2") - F.col("n")).alias("psi"))


def reindexed_profiles(profiles: DataFrame, aligned: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Profiles with the k-th row moved to the alignment column of the k-th residue.

    With ``kept`` (``pos``), the columns that trimming left, other rows are dropped and
    the indexes stay.
    """
    places = residues(aligned).filter("residue != '-'")
    places = places.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    rows = profiles.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("indx")))
    moved = rows.drop("indx").join(places.select("id", "k", F.col("pos").alias("indx")), ["id", "k"]).drop("k")
    return moved if kept is None else moved.join(kept.select(F.col("pos").alias("indx")), "indx", "left_semi")


def gap_limit(trim: float | str) -> float:
    """The largest share of gaps that a column may have: ``all`` lets none through, ``clean`` only drops columns of nothing else."""
    return {"all": 0.0, "clean": math.nextafter(1.0, 0.0)}.get(trim, trim)


def column_gaps(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, pos, gaps``: the share of gaps in each column of every alignment ``by, id, seq``."""
    by = by or []
    rows = aligned.select(*by, F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "residue"))
    return rows.groupBy(*by, "pos").agg(F.avg((F.col("residue") == "-").cast("double")).alias("gaps"))


def trimmed_columns(aligned: DataFrame, trims: Iterable[float | str], by: list[str] | None = None, least_ratio: float = 0.5) -> DataFrame:
    """``by, pos`` of the columns that the first usable trim of each alignment leaves, all of them where none is usable.

    A trim is usable if no string loses all its residues and the mean length stays at
    ``least_ratio`` of what it was or more.  All trims are tried in one pass: each string's
    length under each of them is a sum.
    """
    by, limits = by or [], [gap_limit(t) for t in trims]
    shares = column_gaps(aligned, by)
    rows = aligned.select(*by, "id", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "residue"))
    long = rows.join(shares, [*by, "pos"])
    real = (F.col("residue") != "-").cast("long")
    kept = [F.sum(F.when(F.col("gaps") <= limit, real).otherwise(0)).alias(f"n{k}") for k, limit in enumerate(limits)]
    lengths = long.groupBy(*by, "id").agg(F.sum(real).alias("n"), *kept)
    usable = [((F.min(f"n{k}") > 0) & (F.sum(f"n{k}") >= least_ratio * F.sum("n"))) for k in range(len(limits))]
    first = F.coalesce(*[F.when(u, F.lit(limit)) for u, limit in zip(usable, limits, strict=True)], F.lit(1.0))
    chosen = lengths.groupBy(*by).agg(first.alias("limit"))
    joined = shares.join(chosen, by) if by else shares.crossJoin(F.broadcast(chosen))  # one row
    return joined.filter(F.col("gaps") <= F.col("limit")).select(*by, "pos")


def consensus(aligned: DataFrame) -> DataFrame:
    """``consensus``: the commonest residue of each column, the smaller one of a tie."""
    counts = residues(aligned).groupBy("pos", "residue").agg(F.count("*").alias("n"))
    top = counts.groupBy("pos").agg(F.min(F.struct(-F.col("n"), "residue"))["residue"].alias("residue"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "residue"))), lambda x: x["residue"]), "").alias("consensus"))
