"""Packing of tokenised documents into sequences by exact-complement hashing.

Texts become token ids inside Spark tasks.  How pieces share sequences depends on
their lengths alone, and there are at most ``CAPACITY`` of these, so the plan is made
on the histogram of lengths, whatever the number of documents: a step serves every
piece of a length at once.  Longest first, the gap that a piece leaves is looked up
among single lengths, sums of two and sums of three, and combinations that fill it
exactly are used as often as their counts allow; what has no exact complement goes
best-fit into the smallest gap that takes it.

A plan row sends a run of the pieces of one length, by rank, to consecutive
sequences at one offset.  Every step uses up a length or a group of open sequences,
so the plan has a few rows per length and its size doesn't depend on the input.
Ranks are counted within a length and a salt, so copies that give a third of all
pieces one length are ranked by many tasks.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.staging import stage

CAPACITY = 4096
END_ID = 1
SALTS = 64
#: Texts tokenised at a time, in bytes, new words encoded at a time, and words whose ids a worker remembers.
CHUNK_BYTES = 1 << 20
ENCODED_WORDS = 4096
REMEMBERED = 600_000

_tokenizers: dict = {}


def default_tokenizer() -> str:
    """Path of the tokenizer that the numbered query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known:
    """Ids of strings that a worker has tokenised, in one array, by the string's number.

    The tokenizer never joins across white space, treats a run of letters and the run of
    marks behind it apart, and lower-cases letter by letter; so a text's ids follow from
    those of its words, and those of a plain word from its letters in lower case and its
    marks.  Plain is: Latin letters up to U+00FF, then ASCII marks without the apostrophe.
    Any other word is tokenised as it stands.
    """

    PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.add([""], [[]])
        self.end = self.add([None], [[END_ID]])

    def add(self, strings: list, ids: list) -> int:
        first = len(self.numbers)
        self.numbers.update(zip(strings, range(first, first + len(strings)), strict=True))
        self.sizes = np.concatenate([self.sizes, [len(x) for x in ids]])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), dtype=np.uint32)])
        return first

    def numbered(self, strings: list[str]) -> np.ndarray:
        new = [w for w in strings if w not in self.numbers]
        if new:
            parts = (new[k : k + ENCODED_WORDS] for k in range(0, len(new), ENCODED_WORDS))
            # an encoding takes a hundred times the memory of its ids: few exist at a time
            self.add(new, [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        return np.fromiter(map(self.numbers.__getitem__, strings), dtype=np.int64, count=len(strings))


def _ids(texts: pa.Array, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, each text's followed by the end id, and where each text ends."""
    if len(known.numbers) > REMEMBERED:
        known.forget()
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    parts = pc.extract_regex(words, known.PLAIN)
    plain = parts.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.zeros((len(words) + 1, 2), dtype=np.int64)
    for column, strings in enumerate((pc.utf8_lower(pc.struct_field(parts, 0)), pc.struct_field(parts, 1))):
        own = strings.filter(pa.array(plain)).dictionary_encode()
        numbers[:-1, column][plain] = known.numbered(own.dictionary.to_pylist())[own.indices.to_numpy()]
    numbers[:-1, 0][~plain] = known.numbered(words.filter(pa.array(~plain)).to_pylist())
    numbers[-1, 0] = known.end
    ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    use = numbers[np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(words))].ravel()
    n = known.sizes[use]
    starts = (np.cumsum(known.sizes) - known.sizes)[use]
    stops = np.cumsum(n)
    out = known.ids[np.repeat(starts - (stops - n), n) + np.arange(stops[-1])]
    return out, stops[1::2][ends + np.arange(len(ends))]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = _Known(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, min(len(texts), int(np.searchsorted(bounds, bounds[lo] + CHUNK_BYTES, side="right")) - 1))
                ids, ends = _ids(texts.slice(lo, hi - lo), _tokenizers[path])
                begins = np.concatenate(([0], ends[:-1]))
                counts = -(-(ends - begins) // capacity)
                doc = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[doc] - start)
                at = begins[doc] + start
                data = ids.astype("<u4")
                sums = [zlib.crc32(data[a : a + n]) for a, n in zip(at, length, strict=True)]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(np.array(sums, dtype=np.int64)),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    edges = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(data.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi
                pa.default_memory_pool().release_unused()

    return run


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return source.mapInArrow(_pieces(path or default_tokenizer(), capacity, with_ids), schema)


class _Plan:
    """Runs of equal pieces and the sequences they go to."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.sums = None

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next ``n`` pieces of a length, one to each of ``n`` sequences."""
        self.rows.append((length, int(self.used[length]), int(self.used[length]) + n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def together(self, lengths: list[int], n: int) -> int:
        """``n`` new sequences of these lengths each; returns the first."""
        first, offset = self.sequences, 0
        for length in lengths:
            self.put(length, n, first, offset)
            offset += length
        self.sequences += n
        return first

    def pair(self, gap: int, left: np.ndarray) -> list[int] | None:
        low = np.arange(1, gap // 2 + 1)
        good = (left[low] > 0) & (left[gap - low] > 0)
        if gap % 2 == 0 and gap:
            good[-1] = left[gap // 2] > 1
        return [int(gap - low[good][-1]), int(low[good][-1])] if good.any() else None

    def index(self) -> np.ndarray:
        """Which sums two available lengths have."""
        here = (self.left > 0).astype(np.float64)
        f = np.fft.rfft(here, 2 * len(here))
        self.sums = np.fft.irfft(f * f)[: len(here)] > 0.5
        return self.sums

    def complement(self, length: int) -> list[int] | None:
        """One, two or three available lengths that fill what a piece leaves."""
        left, gap = self.left.copy(), self.capacity - length
        left[length] -= 1
        if left[gap] > 0:
            return [gap]
        if found := self.pair(gap, left):
            return found
        if self.sums is None:
            self.index()
        for fresh in (False, True):  # an index that is out of date only names too many sums
            thirds = np.flatnonzero((left[:gap] > 0) & self.sums[gap - np.arange(gap)])[::-1]
            for third in thirds.tolist():
                left[third] -= 1
                found = self.pair(gap - third, left)
                left[third] += 1
                if found:
                    return [third, *found]
            if fresh or not len(thirds):
                return None
            self.index()
        return None

    def fill_exactly(self) -> None:
        if n := int(self.left[self.capacity]):
            self.together([self.capacity], n)
        for length in range(self.capacity - 1, 0, -1):
            while self.left[length] > 0 and (rest := self.complement(length)):
                parts = [length, *rest]
                self.together(parts, min(int(self.left[x]) // k for x, k in Counter(parts).items()))
            # no exact complement now means none later: what is left goes best-fit
            self.rest[length], self.left[length] = int(self.left[length]), 0

    def best_fit(self) -> None:
        open_at: dict[int, list[tuple[int, int]]] = {}
        gaps: list[int] = []

        def leave(gap: int, first: int, n: int) -> None:
            if gap and n:
                if gap not in open_at:
                    open_at[gap] = []
                    bisect.insort(gaps, gap)
                open_at[gap].append((first, n))

        for length in range(self.capacity, 0, -1):
            self.left[length] = self.rest.get(length, 0)
            while self.left[length] > 0:
                at = bisect.bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    first, n = open_at[gap].pop()
                    if not open_at[gap]:
                        del open_at[gap], gaps[at]
                    m = min(n, int(self.left[length]))
                    self.put(length, m, first, self.capacity - gap)
                    leave(gap, first + m, n - m)
                    leave(gap - length, first, m)
                    continue
                each = self.capacity // length
                whole, part = divmod(int(self.left[length]), each)
                if whole:
                    leave(self.capacity - each * length, self.together([length] * each, whole), whole)
                if part:
                    leave(self.capacity - part * length, self.together([length] * part, 1), 1)

    def run(self) -> list[tuple[int, int, int, int, int]]:
        self.rest: dict[int, int] = {}
        self.fill_exactly()
        self.best_fit()
        return self.rows


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset) for a histogram of lengths 1 to ``capacity``."""
    return _Plan(counts, capacity).run()


def _placed(rows: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            new = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` needs ``doc_id, piece, length, ids_crc32``, lengths from 1 to
    ``capacity``; it is read twice and should be a table.  All columns are kept.  Equal
    rows share no place.  An empty table gives an empty result.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(bases, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("row") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(counts, capacity)), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document and its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone; a document of more than ``capacity`` ids is
    cut into full pieces and a last one.  Rows of one doc_id, and rows without one, are
    documents of their own.  Other columns are ignored.
    """
    return pack(stage(tokenize(docs, path, capacity), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from placed pieces that carry ``ids``: at most ``capacity`` ids in each group."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
