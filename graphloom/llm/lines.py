"""Document quality from a line-labelling conditional random field.

Every line of a document is good or bad; its features are counts over its own bytes
and words and those of the lines before and after it.  Lines take the label of their
document in training, on at most ``TRAIN_DOCS`` documents a label, in the order of a
digest of the id.  A document's score is the mean of the lines' forward-backward
probability of good, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.crf import ChainCRF
from graphloom.llm.words import distinct_in_rows, mix, text_chunks, word_hashes

TRAIN_DOCS = 1500
GOOD_FROM = 0.7

#: Byte classes that are counted per line.
_KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "!", "|", ".,;:?", "\"'()[]{}=/\\+_@~^`-")
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate(_KINDS):
    _CLASS[list(_chars.encode())] = _i + 1


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines of each text) of the lines of a chunk of texts.

    Lines end at newlines; those without a word are left out.  A text without any word
    has one empty line.
    """
    n_docs = len(bounds) - 1
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.concatenate([bounds, breaks]))  # an empty text has no edge of its own
    edges = edges[edges <= len(data)]
    words, row, starts, ends = word_hashes(data, edges, lower=False) if len(data) else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    used = np.unique(row)
    line = np.searchsorted(used, row)
    n = len(used)
    size = (edges[1:] - edges[:-1])[used] if n else np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, edges[used], side="right") - 1 if n else np.zeros(0, np.int64)
    chars = np.maximum(1, size).astype(np.float64)
    counts = []
    for kind in range(1, len(_KINDS) + 1):
        hits = np.searchsorted(edges, np.flatnonzero(_CLASS[data] == kind), side="right") - 1
        counts.append(np.bincount(hits, minlength=len(edges))[used] / chars if n else chars)
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    width = (ends - starts).astype(np.float64)
    per_word = np.maximum(1, n_words)
    own = distinct_in_rows(line, words)[0] if n else line
    first = np.cumsum(n_words.astype(np.int64)) - n_words.astype(np.int64)
    place = np.arange(len(words)) - np.repeat(first, n_words.astype(np.int64))
    same = np.add.reduceat(mix(words + place.astype(np.uint64)), first) if n else words
    order = np.lexsort((np.arange(n), same, doc))
    again = np.zeros(n)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (same[order[1:]] == same[order[:-1]])
    features = np.stack(
        [
            *counts, np.log1p(size), np.log1p(n_words), np.bincount(line, width, minlength=n) / per_word / 10,
            np.bincount(line, width <= 3, minlength=n) / per_word, np.bincount(line, width > 20, minlength=n) / per_word,
            np.bincount(own, minlength=n) / per_word, again,
        ],
        axis=1,
    ) if n else np.zeros((0, len(_KINDS) + 7))
    lines = np.bincount(doc, minlength=n_docs)
    empty = np.flatnonzero(lines == 0)
    if len(empty):  # one empty line each
        at = np.concatenate([doc, empty])
        keep = np.argsort(at, kind="stable")
        features = np.vstack([features, np.zeros((len(empty), features.shape[1]))])[keep]
        size = np.concatenate([size, np.ones(len(empty), dtype=np.int64)])[keep]
        lines[empty] = 1
    return _with_neighbours(features, lines), size, lines


def _with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it, and edge marks."""
    starts = np.cumsum(lines) - lines
    begins, stops = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    begins[starts], stops[starts + lines - 1] = True, True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begins], after[stops] = 0, 0
    return np.hstack([x, before, after, begins[:, None], stops[:, None]])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ChainCRF:
    """The field fitted to ``labels(doc_id, quality)``: at most ``train_docs`` documents a label reach the driver.

    Of rows that repeat a labelled id, the text first in order stands for it; a null
    text is an empty one.
    """
    chosen = None
    for label in (0, 1):
        some = labels.filter(F.col("quality") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        some = some.withColumn("quality", F.lit(label))
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id", "quality").toArrow()
    texts, y = rows.column("text").combine_chunks(), rows.column("quality").to_numpy()
    if not len(y):
        texts, y = pa.array(["", ""]), np.array([0, 1])
    parts = [(f, n) for _, _, data, bounds in text_chunks(texts) for f, _, n in [line_features(data, bounds)]]
    x, lines = np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    share = np.bincount(y, minlength=2) / len(y)
    weights = np.repeat(1 / np.maximum(share[y], 1e-9) / lines, lines)  # labels alike, documents alike
    return ChainCRF(2).fit(x, np.repeat(y, lines), lines, weights / weights.mean())


def _scored(model: ChainCRF):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, bounds in text_chunks(batch.column("text")):
                x, size, lines = line_features(data, bounds)
                good = model.marginals(x, lines)[:, 1]
                at = np.cumsum(lines) - lines
                score = np.add.reduceat(good * size, at) / np.add.reduceat(size.astype(np.float64), at)
                ids = batch.column("doc_id").slice(first, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: ChainCRF, good_from: float = GOOD_FROM) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``doc_id, text``, from its text alone.

    Null, empty and blank texts are one empty line.  Repeated rows score alike; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select("doc_id", "score", (F.col("score") >= good_from).cast("int").alias("predicted"))
