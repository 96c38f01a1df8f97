"""Words of Arrow text columns as flat numpy arrays, a few megabytes at a time.

A word is a run of characters other than space and U+0009 to U+000D.  Work is
done on the UTF-8 buffers of an Arrow column, so there is no Python object per
word, and in chunks of whole texts, so memory follows the chunk (or the longest
single text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, start of each row and end) of runs of whole texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        last = min(last, len(column))
        yield row, last - row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row, byte start and byte end of every word of a chunk.

    ``lower`` folds A-Z, and nothing else, to a-z first.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True  # a text never continues the one before it
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    terms = _BYTE_CODES[data[at]] * powers[place]
    hashes = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return mix(hashes ^ lengths.astype(np.uint64)), rows, starts, ends


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of ``size`` words; a shorter text is one shingle of all its words."""
    if not len(words):
        return rows, words
    n = len(words) - size + 1
    out_rows, out = [], []
    if n > 0:
        whole = rows[:n] == rows[size - 1 :]
        h = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            h = (h + words[i : i + n]) * _BASE
        out_rows.append(rows[:n][whole])
        out.append(mix(h[whole]))
    counts = np.bincount(rows)
    starts = np.cumsum(counts) - counts
    for k in range(1, size):
        few = np.flatnonzero(counts == k)
        if len(few):
            h = np.full(len(few), k, dtype=np.uint64)
            for i in range(k):
                h = (h + words[starts[few] + i]) * _BASE
            out_rows.append(few)
            out.append(mix(h))
    all_rows, all_hashes = np.concatenate(out_rows), np.concatenate(out)
    if len(out) > 1:
        order = np.argsort(all_rows, kind="stable")
        all_rows, all_hashes = all_rows[order], all_hashes[order]
    return all_rows, all_hashes


def distinct_in_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending within it."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]
