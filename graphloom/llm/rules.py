"""Quality rules: a hashed n-gram log-likelihood ratio after base rules (DataFrame functions only).

Words and word pairs are hashed to ``BUCKETS`` buckets.  The trusted target is the
text of all documents labelled good; the raw corpus is every document.  A document's
score is the mean over its n-grams of log(target share / raw share) of their buckets,
so its length does not count, and one fixed threshold decides.

The shares are cross-fitted: texts fall into ``FOLDS`` folds by their digest, and a text
is scored by the counts of the other folds alone.  So neither a document nor an exact
copy of it is in the counts that judge it, and trusted and other documents are treated
alike.  The target's shares lean on the raw ones with the weight of ``STRENGTH`` n-grams
a bucket: with few trusted texts, scores stay near 0, and without any all are 0.

The counts are partial sums over a fixed number of buckets; the ratios, one array of
that length a fold, reach the tasks as a scalar subquery; scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
FOLDS = 4
#: Longs of the filter of trusted ids: 64 bits each, half a megabyte in all, whatever the corpus.
FILTER_LONGS = 1 << 16
SMOOTHING = 1.0
STRENGTH = 16.0
THRESHOLD = -0.05
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    spaced = F.coalesce(text, F.lit(""))
    for c in WHITE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # one plain character needs no pattern matcher
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hashed_words(text: Column) -> Column:
    """64-bit hashes of the words of a text: words, pairs and windows are all told apart by these."""
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


def single_bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def pair_buckets(hashes: Column) -> Column:
    """Bucket of every pair of neighbouring words; the last word has none and gives a null."""
    after = F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1)))
    return F.zip_with(hashes, after, lambda x, y: F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int")))


def ngram_buckets(hashes: Column) -> Column:
    """Buckets of every word and every pair of neighbouring words, and one null."""
    return F.concat(F.transform(hashes, single_bucket), pair_buckets(hashes))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Of hashed words, those that lie in a window of ``window`` words found twice or more in the text."""

    def hashed(w: Column) -> Column:
        starts = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(window)]))

    def following(x: Column) -> Column:
        return F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            # sorted by hash, a window is repeated if its neighbour on either side is equal
            same = F.zip_with(s, following(s), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))

            def marked(e: Column) -> Column:
                either = F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda x, y: F.coalesce(x, F.lit(False)) | y)
                return F.filter(F.zip_with(s, either, lambda x, y: F.when(y, x["i"])), lambda i: i.isNotNull())

            return _bound(same, marked)

        return _bound(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def union_length(at: Column) -> Column:
        steps = lambda p: F.zip_with(p, following(p), lambda x, y: F.least(F.lit(window), F.coalesce(y - x, F.lit(window))))
        return F.aggregate(_bound(F.array_sort(at), steps), F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(union_length(covered(h)))

    return _bound(hashed(words), count)


def fold_of(text: Column) -> Column:
    """Fold of a text, from 0; copies share one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def judged(text: Column, ratios: Column, threshold: float) -> Column:
    """Struct of what the words of a text decide: counts, score and verdict.

    Everything hangs on one binding of the words and one of the fold's ratios, so no
    plan, wherever the optimiser moves it, splits a text more than once per use of the
    struct.
    """

    def mean(hashes: Column, own: Column) -> Column:
        singles = F.aggregate(hashes, F.lit(0.0), lambda acc, x: acc + own[single_bucket(x)])
        pairs = F.aggregate(pair_buckets(hashes), F.lit(0.0), lambda acc, x: acc + F.coalesce(own[x], F.lit(0.0)))
        return F.when(F.size(hashes) > 0, (singles + pairs) / (2 * F.size(hashes) - 1))

    def measures(own: Column) -> Column:
        return _bound(
            hashed_words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), mean(w, own).alias("score")),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & F.coalesce(m["score"] >= threshold, F.lit(False))
        return F.struct(m["n_words"].alias("n_words"), m["n_repeat_words"].alias("n_repeat_words"), m["score"].alias("score"), failed.alias("base_failed"), kept.alias("kept"))

    return _bound(_bound(ratios[fold_of(text)], measures), verdict)


def _place_in_filter(key: Column) -> tuple[Column, Column]:
    """Which long of the filter, and which of its bits, stands for a key."""
    h = F.xxhash64(key.cast("string"))
    return F.pmod(F.shiftright(h, 6), F.lit(FILTER_LONGS)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def id_filter(ids: DataFrame) -> DataFrame:
    """One row, ``bits``: ``FILTER_LONGS`` longs in which every id of ``ids`` has its bit set, others by chance only."""
    word, bit = _place_in_filter(F.col("doc_id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    longs = ids.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    every = ids.sparkSession.range(FILTER_LONGS).select(F.col("id").cast("int").alias("word")).join(longs, "word", "left").fillna(0)
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``text, trusted`` (0 or 1) of every row of ``docs``.

    Texts whose id fails the filter of the trusted ids stay where they are; the others
    meet the ids, of any number, by a hashed shuffle, which decides exactly.  So what
    moves are the trusted texts and, beyond some millions of ids, ever more of the rest.
    Rows without an id are not trusted.
    """
    good = trusted.select("doc_id").filter("doc_id is not null").distinct()
    word, bit = _place_in_filter(F.col("doc_id"))
    may_be = F.col("doc_id").isNotNull() & (F.getbit(id_filter(good).scalar()[word], bit) == 1)
    asked = docs.select("doc_id", "text").filter(may_be).join(good.select("doc_id", F.lit(1).alias("trusted")).hint("shuffle_hash"), "doc_id", "left")
    asked = asked.select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    return asked.unionByName(docs.filter(~may_be).select("text", F.lit(0).alias("trusted")))


def log_ratios(docs: DataFrame, trusted: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """One row, ``ratios``: for each fold, log(target share / raw share) of each bucket in the other folds.

    ``trusted`` holds the ids of the trusted documents, of any number.
    """
    # the fold is a column before the explosion: beside it, the whole text would be hashed again for every n-gram
    folded = marked(docs, trusted).select("text", fold_of(F.col("text")).alias("fold"), "trusted")
    grams = folded.select("fold", "trusted", F.explode(_bound(hashed_words(F.col("text")), ngram_buckets)).alias("bucket"))
    counts = grams.filter(F.col("bucket").isNotNull()).groupBy("bucket", "fold").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    folds = range(FOLDS)
    others = [F.sum(F.when(F.col("fold") != k, F.col(name))).alias(f"{name}_{k}") for k in folds for name in ("raw", "target")]
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(counts.groupBy("bucket").agg(*others), "bucket", "left").fillna(0)
    names = [f"{name}_{k}" for k in folds for name in ("raw", "target")]
    rows = every.agg(F.array_sort(F.collect_list(F.struct("bucket", *names))).alias("rows"), *[F.sum(x).alias(x) for x in names])
    prior = strength * BUCKETS

    def of_fold(k: int) -> Column:
        def ratio(x: Column) -> Column:
            raw = (x[f"raw_{k}"] + SMOOTHING) / (F.col(f"raw_{k}") + SMOOTHING * BUCKETS)
            return F.log((x[f"target_{k}"] / raw + prior) / (F.col(f"target_{k}") + prior))

        return F.transform("rows", ratio)

    return rows.select(F.array(*[of_fold(k) for k in folds]).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, strength: float = STRENGTH) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``kept``.

    A null text has no words and fails the base rules; so does any text under 50
    words, whatever its score (null without an n-gram).  Rows of one id are judged
    each by its own text.  Input columns of the names added here are replaced.
    Without trusted documents all scores are 0, and the base rules alone decide.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    columns = [x for x in docs.columns if x not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    # input columns travel in a struct, so none can clash with a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text")).withColumn("ratios", log_ratios(docs, trusted, strength).scalar())
    rows = rows.withColumn("rules", judged(F.col("text"), F.col("ratios"), threshold))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in columns], "rules.n_words", F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "rules.n_repeat_words", "rules.base_failed", "rules.score", "rules.kept",
    )
