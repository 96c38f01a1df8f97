"""Near-duplicate vectors by sorted projection passes.

Vectors with the same components are one class, numbered apart from their ids, which may
repeat.  In every pass each class has a key
of 64 random hyperplane signs; classes are sorted by it (a range-partitioned sort, so
a dense region is split like any other), and each is compared with the ``WINDOW``
classes after it in double precision.  A window that reaches over the end of a task's
range is filled in a second step: the first and last ``WINDOW`` classes of every range,
numbered through all ranges, meet in blocks of that many numbers, so the links found do
not depend on how many ranges there are.  A task returns of each pass the links that join
classes not yet joined in it, a forest and not all pairs of a dense group.  All links give
components.

A link joins two vectors of one component, so the links of every vector are then
counted within its component, in blocks of ``BLOCK`` classes against ``BLOCK``
classes; only counts leave a block, never pairs.  A component of any size is spread
over as many tasks as it has pairs of blocks.

Misses: a pair at cosine 0.95 lies in one window of a pass over N classes with
probability about 0.9^log2(N / WINDOW); at 50,000 classes 16 passes miss one such
pair in a thousand, and far fewer above 0.97.  :func:`passes_for` gives the passes
that a table of another size needs; the query takes those, ``PASSES`` at least.  In a
dense region windows fill with vectors that are no links, so jobs of
``PASSES_PER_JOB`` more passes follow until ``QUIET_JOBS`` successive ones join no two
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.staging import stage
from graphloom.operators.components import connected_components

THRESHOLD = 0.95
PASSES = 16
PASSES_PER_JOB = 4
QUIET_JOBS = 2
WINDOW = 64
BLOCK = 1024
SEED = 11


def passes_for(classes: int, recall: float = 0.999, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes after which a pair just at the threshold has been found with this probability."""
    agree = 1 - math.acos(threshold) / math.pi
    once = agree ** max(1.0, math.log2(max(2, classes) / window))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(once, 0.999))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as unit vectors."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from over- or underflowing
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch whose vectors are equally long, at most 2048 rows each."""
    widths = np.diff(batch.column("embedding").offsets.to_numpy())
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        for i in range(0, len(at), 2048):
            part = batch.take(pa.array(at[i : i + 2048]))
            yield part, _matrix(part.column("embedding"))


def _keyed(passes: int, seed: int | list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_width(batch):
                planes = np.random.default_rng([*np.atleast_1d(seed), x.shape[1]]).normal(size=(x.shape[1], passes * 64))
                bits = np.packbits(x @ planes >= 0, axis=1)
                keys = bits.reshape(len(x), passes, 8).copy().view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * passes)
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    return run


class _Forest:
    """Which classes links have joined so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def joining(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """The links that join two trees."""
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                out.append((min(x, y), max(x, y)))
        return out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of sorted batches with equal ``keys``; a run over several batches comes in several parts."""
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield tuple(values[lo].tolist()), batch.slice(lo, hi - lo)


_FOUND_NAMES = ["a", "b", "width", "pass", "part", "at", "n", "class", "embedding"]


def _found(links: list[tuple[int, int]], kind: pa.DataType) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    n = len(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(n, pa.int32())] * 3, *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, kind)], _FOUND_NAMES
    )


def _neighbours(window: int, threshold: float):
    """Links of sorted rows ``width, pass, class, embedding`` with the rows that follow them in the task, and the task's edge rows.

    A link has ``a, b``.  An edge row, one of the first or last ``window`` rows that the
    task has of a pass, has its place ``at`` among them and their number ``n`` (known at
    the last ones only).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        group, ids, rows, seen, tail, forest = None, np.zeros(0, np.int64), None, 0, None, _Forest()

        def edges(key, part_rows, first_at, n):
            m = part_rows.num_rows
            same = lambda v, t: pa.array(np.full(m, v), t)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), same(key[0], pa.int32()), same(key[1], pa.int32()), same(part, pa.int32()),
                 pa.array(np.arange(first_at, first_at + m)), same(n, pa.int64()), part_rows.column("class"), part_rows.column("embedding")], _FOUND_NAMES
            )

        def last_edges():
            table = pa.Table.from_batches(tail)
            last = table.slice(max(0, table.num_rows - window)).combine_chunks().to_batches()[0]
            return edges(group, last, seen - last.num_rows, seen)

        for key, batch in _runs(batches, ("width", "pass")):
            x, new = _matrix(batch.column("embedding")), batch.column("class").to_numpy()
            if group != key:
                if group is not None:
                    yield last_edges()
                group, ids, rows, seen, tail, forest = key, new[:0], x[:0], 0, [], _Forest()
            if seen < window:
                yield edges(key, batch.slice(0, window - seen), seen, -1)
            seen += len(new)
            held = sum(b.num_rows for b in tail)
            tail.append(batch.select(["class", "embedding"]))
            while held and held + len(new) - tail[0].num_rows >= window:
                held -= tail.pop(0).num_rows
            old = len(ids)
            ids, rows = np.concatenate([ids, new]), np.concatenate([rows, x])
            for d in range(1, min(window, len(ids) - 1) + 1):
                first = max(0, old - d)  # pairs of two earlier rows have been seen
                near = np.einsum("ij,ij->i", rows[first:-d], rows[first + d :]) >= threshold
                if near.any():
                    links = forest.joining(ids[first:-d][near].tolist(), ids[first + d :][near].tolist())
                    if links:
                        yield _found(links, batch.column("embedding").type)
            ids, rows = ids[-window:], rows[-window:]
        if group is not None:
            yield last_edges()

    return run


def _across(window: int, threshold: float):
    """Links between rows of different tasks in each run of ``width, pass, block``: rows of the block with later ones up to ``window`` on."""

    def links(batches: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        table = pa.Table.from_batches(batches)
        x, ids = _matrix(table.column("embedding").combine_chunks()), table.column("class").to_numpy()
        at, part, own = (table.column(k).to_numpy() for k in ("rank", "part", "own"))
        near = x[own] @ x.T >= threshold
        ahead = at[None, :] - at[own][:, None]
        near &= (ahead > 0) & (ahead <= window) & (part[own][:, None] != part[None, :])
        i, j = np.nonzero(near)
        return _Forest().joining(ids[own][i].tolist(), ids[j].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for now, batch in _runs(batches, ("width", "pass", "block")):
            if key not in (None, now):
                if found := links(held):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["a", "b"])
                held = []
            key = now
            held.append(batch)
        if held and (found := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _counts(threshold: float):
    """Links of the rows of each run of ``component, i, j``, i <= j, sorted: those of block i with those of block j, counted on both sides."""

    def links(key, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        x, at = _matrix(table.column("embedding").combine_chunks()), table.column("at").to_numpy()
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        left, right = at == key[1], at == key[2]
        near = x[left] @ x[right].T >= threshold
        near &= ids[left][:, None] != ids[right][None, :]
        counts = [near @ copies[right]] if key[1] == key[2] else [near @ copies[right], copies[left] @ near]
        names = [ids[left]] if key[1] == key[2] else [ids[left], ids[right]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(counts))], ["class", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for now, batch in _runs(batches, ("component", "i", "j")):
            if key not in (None, now):
                yield links(key, held)
                held = []
            key = now
            held.append(batch)
        if held:
            yield links(key, held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, seed: int = SEED, quiet_jobs: int = QUIET_JOBS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Vectors that are null, empty, zero or hold a null or non-finite component, and
    rows without an id, link with nothing: they have no links, themselves as component
    and are kept.  Vectors of different lengths are never linked.  Repeated rows count
    as vectors of their own.  Other columns are ignored; an empty table gives an empty
    result.  ``passes`` come first, by default as many as the number of classes needs; more
    follow while they still join components.
    """
    rows = vectors.select("vec_id", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    linkable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & some, F.lit(False))
    classes = rows.filter(linkable).groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    item = vectors.schema["embedding"].dataType.simpleString()
    schema = f"embedding {item}, class long, copies long"
    keyed = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    if passes is None:
        passes = max(PASSES, passes_for(keyed.count(), threshold=threshold, window=window))

    def pairs(turn: int) -> DataFrame:
        """Links that one job of passes finds."""
        n = PASSES_PER_JOB if turn >= jobs else min(PASSES_PER_JOB, passes - turn * PASSES_PER_JOB)
        rows = keyed.select("embedding", "class", "copies").mapInArrow(_keyed(n, [seed, turn]), f"{schema}, keys array<long>")
        rows = rows.select(F.size("embedding").alias("width"), "class", "embedding", F.posexplode("keys").alias("pass", "key"))
        order = ["width", "pass", "key", "class"]
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        ddl = f"a long, b long, width int, pass int, part int, at long, n long, class long, embedding {item}"
        found = stage(ordered.mapInArrow(_neighbours(window, threshold), ddl), "neighbours")
        # how many rows of the pass come before each task's: one row per task and pass
        pieces = found.filter("n >= 0").groupBy("width", "pass", "part").agg(F.max("n").alias("n"))
        ahead = Window.partitionBy("width", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select("width", "pass", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        edge = found.filter("a is null").select("width", "pass", "part", "at", "class", "embedding").dropDuplicates(["width", "pass", "part", "at"])
        edge = edge.join(pieces, ["width", "pass", "part"]).withColumn("rank", F.col("before") + F.col("at"))
        own = F.floor(F.col("rank") / window)
        edge = edge.withColumn("block", F.explode(F.array(own - 1, own))).withColumn("own", F.col("block") == own)
        edge = edge.select("width", "pass", "block", "rank", "part", "own", "class", "embedding")
        across = edge.repartition("width", "pass", "block").sortWithinPartitions("width", "pass", "block").mapInArrow(_across(window, threshold), "a long, b long")
        return stage(found.filter("a is not null").select("a", "b").unionByName(across).distinct(), "near")

    jobs = -(-passes // PASSES_PER_JOB)
    parts = connected_components(reduce(DataFrame.unionByName, [pairs(turn) for turn in range(jobs)]))
    turn, quiet = jobs, 0
    while quiet < quiet_jobs:
        found = pairs(turn)
        for end in ("a", "b"):
            part = parts.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}"))
            found = found.join(part, end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))
        new = stage(found.filter("part_a != part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct(), "new")
        quiet, turn = quiet + 1, turn + 1
        if not new.isEmpty():
            quiet = 0
            parts = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))

    members = keyed.select("class", "copies", "embedding").join(parts.select(F.col("id").alias("class"), "component"), "class")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stage(members.join(sizes, "component"), "members").withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # each vector meets every block once: as block i of pairs (i, j) or block j of pairs (j, i)
    met = members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), "at", "class", "copies", "embedding")
    blocks = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = blocks.mapInArrow(_counts(threshold), "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))

    # a component bears the smallest id of its vectors
    of = parts.select(F.col("id").alias("class"), "component")
    names = keyed.select("class", "first_id").join(of, "class").groupBy("component").agg(F.min("first_id").alias("smallest"))
    named = (
        keyed.select("embedding", "class", "first_id", "copies")
        .join(of.join(names, "component").select("class", "smallest"), "class", "left")
        .join(counted, "class", "left")
        .select("embedding", F.coalesce("smallest", "first_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    linked = rows.filter(linkable).join(named, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
