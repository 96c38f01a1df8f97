"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes the set of its distinct five-word shingles, 120 minima
   of that set, 24 band keys (five whole minima each) and a packed signature: the
   low four bits of each minimum, 480 bits a document.
2. Documents of one set are one class; everything below works on classes.
3. Classes that share a band key are candidates.  Agreement of two packed
   signatures, counted by XOR and bit counts, gives the similarity after the
   correction for chance collisions (one in sixteen); pairs estimated far below the
   threshold (five standard deviations) are left out.
4. The rest is confirmed on the full sets, and components are taken.

A bucket of M classes is not expanded into M*M pairs.  First every member meets
the bucket's smallest class and its hub, the class with most company over all bands
(the text that a family of copies was made from is in more and fuller buckets than
they are), and components are taken.  Then only buckets that still hold more than
one component give pairs, and only pairs across components: of each bucket, the
members outside its largest component against all members.  Pairs inside a
component can't change it, so no bucket needs a cap and no link between
components is lost.  These pairs are tested on their full sets, by blocks of ``BLOCK``
members, inside the tasks; only links leave a task.

Misses: a pair at similarity 0.85 shares no band with probability (1-0.85^5)^24,
below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.staging import stage
from graphloom.llm.words import distinct_in_rows, mix, shingle_hashes, text_chunks, word_hashes
from graphloom.operators.components import connected_components

SHINGLE_WORDS = 5
BANDS, BAND_ROWS, LOW_BITS = 24, 5, 4
PERMUTATIONS = BANDS * BAND_ROWS
PER_LONG = 64 // LOW_BITS
SIGNATURE_LONGS = -(-PERMUTATIONS // PER_LONG)
#: Estimates this far below the threshold are not confirmed (five standard deviations).
MARGIN = 0.17
#: Members of a bucket that one task compares with as many others.
BLOCK = 512

_rng = np.random.default_rng(7_2024)
_FACTORS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)

_SIGNED = "n_shingles long, set_hi long, set_lo long, bands array<long>, signature array<long>"


def _sign(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
    """Set sizes, two set fingerprints, band keys and packed signatures of a chunk's distinct shingles."""
    counts = np.bincount(rows, minlength=n_rows)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    prints = np.zeros((2, n_rows), dtype=np.uint64)
    bands = np.zeros((n_rows, BANDS), dtype=np.uint64)
    packed = np.zeros((n_rows, SIGNATURE_LONGS), dtype=np.uint64)
    if len(full):
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            prints[i, full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts)
        for j in range(PERMUTATIONS):
            low = np.minimum.reduceat((hashes ^ _SHIFTS[j]) * _FACTORS[j], starts)
            low = mix(low + np.uint64(j))
            band = j // BAND_ROWS
            bands[full, band] = mix(bands[full, band] + low + np.uint64(band))
            packed[full, j // PER_LONG] |= (low & np.uint64(2**LOW_BITS - 1)) << np.uint64(LOW_BITS * (j % PER_LONG))
    return counts, prints[0], prints[1], bands, packed


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, data, bounds in text_chunks(batch.column("text")):
            words, rows, _, _ = word_hashes(data, bounds)
            rows, hashes = distinct_in_rows(*shingle_hashes(words, rows, SHINGLE_WORDS))
            counts, hi, lo, bands, packed = _sign(rows, hashes, n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, n), batch.column("print").slice(first, n), pa.array(counts.astype(np.int64)),
                    pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), _lists(bands), _lists(packed),
                ],
                ["id", "print", "n_shingles", "set_hi", "set_lo", "bands", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, data, bounds in text_chunks(batch.column("text")):
            words, rows, _, _ = word_hashes(data, bounds)
            rows, hashes = distinct_in_rows(*shingle_hashes(words, rows, SHINGLE_WORDS))
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class").slice(first, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))],
                ["class", "shingles"],
            )


def _crossing(percent: int):
    """Links of the asking rows of each run of ``band, i, j`` with its other rows, across components."""

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        asks = rows.column("asks").to_numpy()
        if not asks.any() or asks.all():
            return None
        ids, parts = rows.column("class").to_numpy(), rows.column("component").to_numpy()
        main = rows.column("main")[0].as_py()
        sets = rows.column("shingles").combine_chunks()
        bounds = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))))
        values = sets.flatten().to_numpy()
        others = np.flatnonzero(~asks)
        sizes = np.diff(bounds)
        place = np.repeat(np.arange(len(rows)), sizes)
        here = ~asks[place]
        found, owner = values[here], np.repeat(np.arange(len(others)), sizes[others])
        order = np.argsort(found, kind="stable")
        found, owner = found[order], owner[order]
        out_a, out_b = [], []
        for q in np.flatnonzero(asks):
            own = values[bounds[q] : bounds[q + 1]]
            low = np.searchsorted(found, own, side="left")
            n = np.searchsorted(found, own, side="right") - low
            hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[hits], minlength=len(others))
            near = 100 * shared >= percent * (sizes[q] + sizes[others] - shared)
            near &= (parts[others] != parts[q]) & ((parts[others] == main) | (ids[others] > ids[q]))
            out_b.append(ids[others[near]])
            out_a.append(np.full(len(out_b[-1]), ids[q]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("band", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if key is not None and key != tuple(keys[lo]):
                    if (found := links(pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held and (found := links(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def estimated_similarity(a: str, b: str) -> F.Column:
    """Collision-corrected Jaccard estimate of two packed signature columns, by bit counts."""
    ones = sum(1 << (LOW_BITS * i) for i in range(PER_LONG))
    ones -= 1 << 64 if ones >= 1 << 63 else 0

    def unequal(i: int) -> F.Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for s in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    differ = reduce(lambda x, y: x + y, (unequal(i) for i in range(SIGNATURE_LONGS)))
    chance = 2.0**-LOW_BITS
    return (1 - differ / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        both.withColumn("shared", shared)
        .filter(100 * F.col("shared") >= percent * (F.size("set_a") + F.size("set_b") - F.col("shared")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every document under Jaccard similarity of five-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept`` and nothing of the input's
    other columns, one row for each input row.  Every row is linked by its own text:
    rows that repeat an id, with the same text or others, and rows without an id take
    part like any other.  ``component_id`` is the smallest id that is not null of a
    row's component, null if there is none; ``kept`` is whether the row's id is that
    one (rows of one id in one component are all kept; of a component without ids, all).
    Null, empty and blank texts have no shingles, link with nothing, have their own id
    as component and are kept.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    signed = stage(source.mapInArrow(_signed, f"id long, print long, {_SIGNED}"), "signed")
    fingerprint = ["set_hi", "set_lo", "n_shingles"]
    # a class is a set of shingles; the row of the smallest id (and text) stands for it
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("rep")
    classes = signed.filter("n_shingles > 0").groupBy(*fingerprint).agg(F.min("id").alias("low_id"), rep)
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    named = classes.select(*fingerprint, F.col("rep.id").alias("id"), F.col("rep.print").alias("print"), "class")
    same_row = (F.col("s.id").eqNullSafe(F.col("c.id"))) & (F.col("s.print") == F.col("c.print"))
    matched = signed.alias("s").join(named.alias("c"), same_row & (F.col("s.set_hi") == F.col("c.set_hi")) & (F.col("s.set_lo") == F.col("c.set_lo")))
    firsts = stage(matched.select("c.class", "s.bands", "s.signature").dropDuplicates(["class"]), "firsts")
    keys = firsts.select("class", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(keys.join(sizes, "band"), "buckets")
    degrees = members.groupBy("class").agg(F.sum("n").alias("degree"))
    # staged, so that the joins below read plain shuffles, whose skewed partitions Spark splits
    heads = members.join(degrees, "class").groupBy("band").agg(
        F.max_by("class", F.struct("degree", -F.col("class"))).alias("hub"), F.min("class").alias("low")
    )
    heads = stage(heads, "heads")
    signatures = firsts.select("class", "signature")
    least = percent / 100 - MARGIN

    def estimated(pairs: DataFrame) -> DataFrame:
        a = signatures.select(F.col("class").alias("a"), F.col("signature").alias("sig_a"))
        b = signatures.select(F.col("class").alias("b"), F.col("signature").alias("sig_b"))
        found = pairs.join(a, "a").join(b, "b").withColumn("estimate", estimated_similarity("sig_a", "sig_b"))
        return found.filter(F.col("estimate") >= least).select("a", "b", "estimate")

    spokes = members.join(heads, "band").select("class", F.explode(F.array("hub", "low")).alias("head")).filter("class != head")
    stars = stage(estimated(spokes.select(F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b")).distinct()), "stars")
    needed = named.join(members.select("class").distinct(), "class", "left_semi")
    texts = source.alias("s").join(needed.alias("c"), same_row).select("c.class", "s.text").dropDuplicates(["class"])
    sets = stage(texts.mapInArrow(_sets, "class long, shingles array<long>"), "sets")
    links = stage(_confirmed(stars, sets, percent), "links")
    parts = connected_components(links)

    labelled = members.select("band", "class", "n").join(
        parts.select(F.col("id").alias("class"), "component"), "class", "left"
    ).withColumn("component", F.coalesce("component", "class"))
    by_part = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = by_part.groupBy("band").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts")
    ).filter("parts > 1")
    labelled = stage(labelled.join(stage(mixed.select("band", "main"), "mains"), "band"), "mixed")
    labelled = labelled.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    labelled = labelled.withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["band", "i", "j", "asks", "class", "component", "main"]
    targets = labelled.withColumn("asks", F.lit(False)).withColumnRenamed("at", "j").withColumn("i", every).select(columns)
    queries = labelled.filter("component != main").withColumn("asks", F.lit(True)).withColumnRenamed("at", "i").withColumn("j", every).select(columns)
    rows = targets.unionByName(queries).join(sets, "class").select(*columns, "shingles")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stage(rows.mapInArrow(_crossing(percent), "a long, b long").distinct(), "links")
    merged = parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = connected_components(merged)

    class_of = classes.join(final.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = class_of.groupBy("component").agg(F.min("low_id").alias("low_id"))
    class_of = class_of.select(*fingerprint, "component").join(lowest, "component").drop("component")
    component = F.when(F.col("n_shingles") > 0, F.col("low_id")).otherwise(F.col("id"))
    return (
        signed.select("id", *fingerprint)
        .join(class_of, fingerprint, "left")
        .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
    )
