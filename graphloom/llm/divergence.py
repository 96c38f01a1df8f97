"""Source divergence audit: which terms set a source apart from its language, and how far sources of a language differ.

A term is a run of ASCII letters and characters from U+0080 on, A-Z lower-cased.  Each
language keeps the terms that stand in ``min_docs`` of its documents or more.  A group
(language and source) gives every kept term the smoothed share
``p = 1 + floor(10^9 * (count + 2) / (size + 2 * terms))`` of its occurrences of kept terms,
the language likewise; two shares differ by ``f = floor((p - q)^2 / (p + q))``.

Count cells do the ranking: all terms that a group holds as often as each other and the
language likewise have one f, so terms are grouped by (group count, language count), f is
evaluated once a cell, equal values of different cells are merged, and values are ranked
by the number of terms at or above them.  Only cells that reach the asked ranks are
expanded into their terms, in UTF-8 order.  Two sources are compared by cells too: those
of terms that both hold, and each source's own cells against terms that the other does
not hold, so that nothing is written for terms that are absent from both.

Everything is counted in whole numbers: shares in decimals of 38 digits, sums in longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.staging import drop_staged, stage
from graphloom.llm.words import text_chunks

MIN_DOCS = 10
TOP = 10
CHUNK_BYTES = 4 << 20

#: What the query returns.
SCHEMA = "lang string, source string, part string, item string, value long, rank int"


def _chunk_counts(group: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of every (group, term) of a chunk of texts; ``group`` is given for each text."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))).dictionary_encode()
    codes, k = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    rows = np.searchsorted(bounds, starts, side="right") - 1
    keys, n = np.unique(group[rows] * k + codes, return_counts=True)
    in_rows = np.unique(rows * k + codes)
    _, docs = np.unique(group[in_rows // k] * k + in_rows % k, return_counts=True)
    return keys // k, words.dictionary.take(pa.array(keys % k)), n, docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(i).cast(pa.string()).fill_null("").dictionary_encode() for i in (0, 1))
        sources = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
        for row, rows, data, bounds in text_chunks(batch.column(2), CHUNK_BYTES):
            if not len(data):
                continue
            groups, terms, n, docs = _chunk_counts(group[row : row + rows], data, bounds)
            columns = [lang.dictionary.take(pa.array(groups // sources)), source.dictionary.take(pa.array(groups % sources)), terms.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "n_docs"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences of each term in each group, and the documents that hold it.

    Texts are counted in chunks of whole texts inside the tasks, so what is shuffled is at
    most one row for a term of a group and a chunk, whatever the share of one group.
    """
    counted = _texts(docs).mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, size: Column, terms: Column) -> Column:
    """The smoothed share of a term that occurs ``count`` times among ``size`` occurrences of ``terms`` terms."""
    parts = F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", parts, (size + 2 * terms).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """How far two shares differ; the same both ways."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """``rows`` numbered within group and part by falling value and rising item; with ``top``, tasks drop what cannot come that far first."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def telling_terms(present: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms that each group uses more than its language, by count cells."""
    cells = present.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms_here")).join(totals, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("lang_n"), F.col("lang_size"), F.col("terms"))
    cells = cells.select("lang", "source", "n", "lang_n", "terms_here", p.alias("p"), q.alias("q")).filter("p > q")
    cells = cells.select("lang", "source", "n", "lang_n", "terms_here", gap(F.col("p"), F.col("q")).alias("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms_here").alias("terms_here"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # every value has a term at least, so ranks to ``top`` lie in the first ``top`` values
    values = values.withColumn("at", F.row_number().over(falling)).filter(F.col("at") <= top)
    before = F.coalesce(F.sum("terms_here").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value")
    reached = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    expanded = present.join(reached, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(expanded, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def source_gaps(present: DataFrame, totals: DataFrame) -> DataFrame:
    """For each group, every other source of its language by the sum of gaps over all kept terms."""
    here = totals.select("lang", "source", "size", "terms")
    there = here.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"))
    zero = F.lit(0).cast("long")
    p = lambda count: share(count, F.col("size"), F.col("terms"))
    q = lambda count: share(count, F.col("item_size"), F.col("terms"))
    # terms that neither holds, as if no term were held: the next two parts take the difference
    both_ways = here.join(there, "lang").filter("source != item")
    neither = both_ways.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * gap(p(zero), q(zero))).otherwise(0).alias("value"))
    # a source's cells against an absent term of the other
    own = present.groupBy("lang", "source", "n").agg(F.count("*").alias("terms_here")).join(both_ways, ["lang", "source"])
    one = own.select("lang", "source", "item", (F.col("terms_here") * (gap(p(F.col("n")), q(zero)) - gap(p(zero), q(zero)))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # cells of terms that both hold, each two sources once
    other = present.select("lang", "term", F.col("source").alias("item"), F.col("n").alias("item_n"))
    cells = present.join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item", "n", "item_n").agg(F.count("*").alias("terms_here"))
    cells = cells.join(here, ["lang", "source"]).join(there, ["lang", "item"])
    extra = gap(p(F.col("n")), q(F.col("item_n"))) - gap(p(F.col("n")), q(zero)) - gap(p(zero), q(F.col("item_n"))) + gap(p(zero), q(zero))
    two = cells.select("lang", "source", "item", (F.col("terms_here") * extra).alias("value"))
    two = two.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.col("value")]
    parts = neither.unionByName(one).unionByName(one.select(*turned)).unionByName(two).unionByName(two.select(*turned))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Both parts of the audit for every (lang, source) group of ``docs``: ``lang, source, part, item, value, rank``.

    Nulls in lang, source and text count as empty strings, an empty string being a language
    or source like any other.  Every row is a document, repeated or not.  A group without
    kept terms has no ``term`` rows and its ``pair`` rows like any other (0 where the
    language keeps no term); a language's only source has no ``pair`` rows.  Equal values
    rank in UTF-8 order of their items.  Other columns do not matter; an empty table gives
    an empty result.
    """
    groups = _texts(docs).select("lang", "source").distinct()
    counts = stage(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    kept = stage(kept.filter(F.col("n_docs") >= min_docs).drop("n_docs"), "kept")
    present = stage(counts.drop("n_docs").join(kept, ["lang", "term"]), "present")
    drop_staged(counts)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_size"))
    sizes = present.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    totals = stage(groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["terms", "lang_size", "size"]), "totals")
    drop_staged(kept)
    return source_gaps(present, totals).unionByName(telling_terms(present, totals, top))
