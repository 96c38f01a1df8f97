"""Collapsing of paralogs: an ordered walk, cut into parts that cannot touch each other.

The walk takes the ids of a graph in order, again and again until nothing changes; an id
whose best hits are all of its own taxon absorbs, one after the other, those of them whose
best hits include it, and what is absorbed leaves the graph.  The outcome hangs on the
order, but only on that of ids that can reach each other:

* An id can ever leave only if some id of its taxon can come to have it as a best hit, and
  be one of its own, once other ids that can leave have left.  The smallest set that is
  closed under this is found in rounds over the whole edge table, a maximum for each node.
* Best hits of a node never fall under its best neighbour that cannot leave, so the edges
  from there up are all that it will ever look at.
* Nodes linked by such edges to what can leave are connected components, each of which is
  walked by itself, in one task if it has at most ``limit`` edges.  A larger one is walked
  as a table, an absorption a round, so no group holds a graph of unknown size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.staging import drop_staged, stage
from graphloom.operators.components import connected_components
from graphloom.operators.similarity import BLOCK, MATRIX_SHARE, PROFILE_SHARE, _Blocks, grouped_blocks, half_up, sides, undirected, usable_vector

LIMIT = 200_000


def leaving(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cluster, id`` of all that can ever leave, and ``cluster, id, floor, other``: each node's best weight to one that cannot, and to one of another taxon.

    ``both`` has ``cluster, src, dst, w, same``, every edge from either end.
    """
    gone, known = None, 0
    while True:
        kept = both if gone is None else both.join(gone.withColumnRenamed("id", "dst"), ["cluster", "dst"], "left_anti")
        floors = kept.groupBy("cluster", F.col("src").alias("id")).agg(F.max("w").alias("floor"), F.max(F.when(~F.col("same"), F.col("w"))).alias("other"))
        floors = stage(floors, "floors")
        lowest = F.lit(float("-inf"))
        ends = [floors.select("cluster", F.col("id").alias(e), F.coalesce("floor", lowest).alias(f"{e}_floor"), F.coalesce("other", lowest).alias(f"{e}_other")) for e in ("src", "dst")]
        reach = both.filter("same").join(ends[0], ["cluster", "src"], "left").join(ends[1], ["cluster", "dst"], "left")
        least = [F.coalesce(c, lowest) for c in ("src_floor", "src_other", "dst_floor")]
        reach = reach.filter((F.col("w") >= least[0]) & (F.col("w") > least[1]) & (F.col("w") >= least[2]))
        found = stage(reach.select("cluster", F.col("dst").alias("id")).distinct(), "leaving")
        n = found.count()
        if n == known:  # the set only grows
            return found, floors
        drop_staged(floors)
        gone, known = found, n


# edges that are made from vectors ---------------------------------------------------------


class _Edges:
    """Two blocks of ``id, vec, taxon`` and the rounded scores of their parts; a column of both sides by its name."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.assign(taxon=pd.factorize(rows["taxon"], use_na_sentinel=False)[0])
        self.blocks, self.parts_of = _Blocks(rows), sides(rows)
        self.ids, self.taxa = self.blocks.ids, self.column("taxon")

    def column(self, name: str) -> list[np.ndarray]:
        return [part[name].to_numpy() for part in self.parts_of]

    def least(self, name: str) -> list[np.ndarray]:
        """A weight of every row, the lowest for none."""
        return [np.nan_to_num(x.astype(float), nan=-np.inf) for x in self.column(name)]

    def parts(self) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """Weights of a part, the lowest where there is no edge, and whether both ends are of one taxon."""
        for a, b, wanted in self.blocks.parts():
            raw = PROFILE_SHARE * self.blocks.psi(a, b) + MATRIX_SHARE * self.blocks.cosine(a, b)
            wanted &= ~np.isnan(raw)
            w = np.full(raw.shape, -np.inf)
            w[wanted] = half_up(raw[wanted], 9) / 1e9
            yield a, b, w, self.taxa[0][a][:, None] == self.taxa[1][b][None, :]


def _floors(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    edges = _Edges(rows)
    gone = edges.column("gone")
    floor, other = ([np.full(len(ids), -np.inf) for ids in edges.ids] for _ in range(2))
    for a, b, w, same in edges.parts():
        for side, at, kept, axis in ((0, a, ~gone[1][b][None, :], 1), (1, b, ~gone[0][a][:, None], 0)):
            left = np.where(kept, w, -np.inf)
            floor[side][at] = np.maximum(floor[side][at], left.max(axis=axis, initial=-np.inf))
            other[side][at] = np.maximum(other[side][at], np.where(same, -np.inf, left).max(axis=axis, initial=-np.inf))
    for ids, x, y in zip(edges.ids, floor, other, strict=True):
        yield pd.DataFrame({"id": ids, "floor": np.where(x > -np.inf, x, np.nan), "other": np.where(y > -np.inf, y, np.nan)})


def _reached(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """What can leave, as :func:`leaving` has it."""
    edges = _Edges(rows)
    floor, other = edges.least("floor"), edges.least("other")
    found = [np.zeros(len(ids), dtype=bool) for ids in edges.ids]
    for a, b, w, same in edges.parts():
        both = same & (w > -np.inf) & (w >= floor[0][a][:, None]) & (w >= floor[1][b][None, :])
        found[1][b] |= (both & (w > other[0][a][:, None])).any(axis=0)
        found[0][a] |= (both & (w > other[1][b][None, :])).any(axis=1)
    for ids, at in zip(edges.ids, found, strict=True):
        yield pd.DataFrame({"id": ids[at]})


def _from_floors(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The edges that an end will ever look at, seen from it."""
    edges = _Edges(rows)
    floor = edges.least("floor")
    for a, b, w, same in edges.parts():
        for m, s, src, dst, low in ((w, same, edges.ids[0][a], edges.ids[1][b], floor[0][a]), (w.T, same.T, edges.ids[1][b], edges.ids[0][a], floor[1][b])):
            i, j = np.nonzero((m > -np.inf) & (m >= low[:, None]))
            yield pd.DataFrame({"src": src[i], "dst": dst[j], "w": m[i, j], "same": s[i, j]})


def collapsed_vectors(vectors: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """:func:`collapsed` over the rounded raw scores of all pairs of ``cluster, id, taxon, vec`` in a cluster.

    Every round makes the pairs anew and takes maxima in the tasks that make them, so no table of
    pairs is written, only the edges from the floors up.
    """
    rows = vectors.filter(usable_vector()).select("cluster", "id", "taxon", "vec")
    kind = vectors.schema["id"].dataType.simpleString()
    gone, known, ends = None, 0, ["cluster", "id"]
    while True:
        marked = rows.withColumn("gone", F.lit(False)) if gone is None else rows.join(gone.withColumn("gone", F.lit(True)), ends, "left").fillna(False, ["gone"])
        floors = grouped_blocks(marked, block, "cluster", _floors, f"id {kind}, floor double, other double")
        floors = stage(floors.groupBy(*ends).agg(F.max("floor").alias("floor"), F.max("other").alias("other")), "floors")
        held = rows.join(floors, ends, "left")
        found = stage(grouped_blocks(held, block, "cluster", _reached, f"id {kind}").distinct(), "leaving")
        n = found.count()
        if n == known:  # the set only grows
            break
        drop_staged(floors)
        gone, known = found, n
    ever = stage(grouped_blocks(held, block, "cluster", _from_floors, f"src {kind}, dst {kind}, w double, same boolean"), "ever")
    return _absorbed(ever, found, vectors.select("cluster", "id"), limit)


# the walk ---------------------------------------------------------------------------------


def _walked(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The ordered walk over ``src, dst, w, same`` of one component: who has absorbed whom."""
    near: dict = {}
    other = {}
    for a, b, w, same in zip(rows["src"], rows["dst"], rows["w"], rows["same"], strict=True):
        near.setdefault(a, {})[b] = w
        other[a, b] = not same
    inside = {b: [a for a in near if b in near[a]] for b in near}

    def tops(i):
        best = max(near[i].values(), default=None)
        return [j for j in sorted(near[i]) if near[i][j] == best]

    into, changed = {}, True
    while changed:
        changed = False
        for i in sorted(near):
            if i in into:
                continue
            hits = tops(i)
            if any(other[i, j] for j in hits):
                continue
            for j in hits:
                if j in near and i in tops(j):
                    into[j], changed = i, True
                    near.pop(j)
                    for k in inside[j]:
                        near.get(k, {}).pop(j, None)
    return pd.DataFrame([(key[0], r, i) for i, r in into.items()], columns=["part", "rep", "id"])


def _walked_as_table(edges: DataFrame) -> DataFrame:
    """``part, rep, id`` of the same walk over the components of ``part, src, dst, w, same``, one absorption of each a round."""
    alive = stage(edges, "alive")
    nothing = edges.select("part", F.col("src").alias("rep"), F.col("dst").alias("id")).limit(0)
    # where each component's walk stands: the id whose turn it is, its last hit, their weight, whether this pass has changed anything
    stands = stage(edges.select("part").distinct().select("part", *[F.lit(None).cast(edges.schema[c].dataType).alias(n) for c, n in (("src", "i"), ("dst", "j"), ("w", "level"))], F.lit(False).alias("changed")), "stands")
    done = nothing
    while not stands.isEmpty():
        top = alive.groupBy("part", "src").agg(F.max("w").alias("top"))
        hits = alive.join(top, ["part", "src"]).filter("w = top")
        own = hits.groupBy("part", "src").agg(F.bool_and("same").alias("own"))
        mutual = alive.join(top.select("part", F.col("src").alias("dst"), F.col("top").alias("back")), ["part", "dst"]).filter("w = back")
        mutual = mutual.join(top, ["part", "src"]).join(own, ["part", "src"]).join(stands, "part")
        goes_on = (F.col("src") == F.col("i")) & (F.col("dst") > F.col("j")) & (F.col("w") == F.col("level"))
        begins = (F.col("w") == F.col("top")) & F.col("own") & (F.col("i").isNull() | (F.col("src") > F.col("i")))
        events = mutual.filter("same").filter(F.coalesce(goes_on, F.lit(False)) | begins)
        events = stage(events.groupBy("part").agg(F.min(F.struct("src", "dst", "w")).alias("e")), "events")
        done = done.unionByName(events.select("part", F.col("e.src").alias("rep"), F.col("e.dst").alias("id")))
        gone = events.select("part", F.col("e.dst").alias("gone"))
        left = alive.join(gone.withColumnRenamed("gone", "src"), ["part", "src"], "left_anti").join(gone.withColumnRenamed("gone", "dst"), ["part", "dst"], "left_anti")
        joined = stands.join(events, "part", "left").filter("e is not null or changed")  # a pass without a change ends the walk
        after = joined.select("part", F.col("e.src").alias("i"), F.col("e.dst").alias("j"), F.col("e.w").alias("level"), F.col("e").isNotNull().alias("changed"))
        left, after = stage(left, "alive"), stage(after, "stands")
        for table in (alive, stands):
            drop_staged(table)
        alive, stands = left, after
    return done


def collapsed(edges: DataFrame, members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cluster, rep, id``: which member each member is collapsed into, itself if into none.

    ``edges`` are ``cluster, seq1, seq2, score`` inside clusters, ``members`` ``cluster, id, taxon``.
    A member without edges stays by itself.
    """
    taxa = members.select("cluster", "id", "taxon")
    both = undirected(edges).select("cluster", "src", "dst", F.col("score").cast("double").alias("w"))
    for end in ("src", "dst"):
        both = both.join(taxa.select("cluster", F.col("id").alias(end), F.col("taxon").alias(f"{end}_taxon")), ["cluster", end])
    both = stage(both.select("cluster", "src", "dst", "w", F.col("src_taxon").eqNullSafe(F.col("dst_taxon")).alias("same")), "both")
    gone, floors = leaving(both)
    # what can leave, and who has it among what it will ever look at
    ever = both.join(floors.select("cluster", F.col("id").alias("src"), "floor"), ["cluster", "src"], "left").filter("floor is null or w >= floor").drop("floor")
    ever = stage(ever, "ever")
    for table in (both, floors):
        drop_staged(table)
    return _absorbed(ever, gone, members, limit)


def _absorbed(ever: DataFrame, gone: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """``cluster, rep, id`` from the edges ``cluster, src, dst, w, same`` that nodes will ever look at and what can leave."""
    links = stage(ever.join(gone.withColumnRenamed("id", "dst"), ["cluster", "dst"], "left_semi").select("cluster", "src", "dst"), "links")
    nodes = links.select("cluster", F.col("src").alias("id")).union(links.select("cluster", "dst")).distinct()
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    numbered = links.join(nodes.select("cluster", F.col("id").alias("src"), F.col("node").alias("a")), ["cluster", "src"]).join(nodes.select("cluster", F.col("id").alias("dst"), F.col("node").alias("b")), ["cluster", "dst"])
    parts = connected_components(numbered.select("a", "b")).withColumnsRenamed({"id": "node", "component": "part"})
    of = stage(nodes.join(parts, "node").select("cluster", "id", "part"), "parts")
    rows = ever.join(of.withColumnRenamed("id", "src"), ["cluster", "src"]).select("part", "src", "dst", "w", "same")
    rows = stage(rows, "rows")
    sizes = stage(rows.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    item = members.schema["id"].dataType.simpleString()
    small = rows.join(sizes.filter(F.col("n") <= limit), "part", "left_semi").groupBy("part").applyInPandas(_walked, f"part long, rep {item}, id {item}")
    large = sizes.filter(F.col("n") > limit).select("part")
    into = small if large.isEmpty() else small.unionByName(_walked_as_table(rows.join(large, "part", "left_semi")))
    into = stage(into.join(of, ["part", "id"]).select("cluster", "rep", "id"), "absorbed")
    for table in (ever, links, nodes, rows, sizes, gone):
        drop_staged(table)
    # what an absorbed id had absorbed goes with it: each id to the end of its way up
    ways = stage(members.select("cluster", "id").join(into, ["cluster", "id"], "left").select("cluster", "id", F.coalesce("rep", "id").alias("rep")), "ways")
    while True:
        up = ways.select("cluster", F.col("id").alias("rep"), F.col("rep").alias("next"))
        after = stage(ways.join(up, ["cluster", "rep"]).select("cluster", "id", F.col("next").alias("rep"), (F.col("rep") != F.col("next")).alias("moved")), "ways")
        drop_staged(ways)
        if after.filter("moved").isEmpty():
            return after.select("cluster", "rep", "id")
        ways = stage(after.drop("moved"), "ways")
        drop_staged(after)
