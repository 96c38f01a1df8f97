"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources ask for words in proportion to their weights; none gets more than
``max_epochs`` times what it has, and what a clamped source can't take is shared
again by weight.  With sources ordered by the water level at which they clamp, the
clamped ones are a prefix, so the level follows from running sums over one row per
source: no loop.

A source's target becomes whole repetitions of all its documents and a fractional
one: documents in the order of a seeded digest, until the words left are used up,
the last of them in part.  The place where they run out is found on digest buckets
(4096 a source, summed before any shuffle); only the one bucket that holds it is
ordered, so a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.staging import stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
MAX_EPOCHS = 2
SHARE = 1.5
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Above any bucket of three hex digits.
AFTER_ALL = "g"


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ticket(doc_id: Column, seed: str = SEED) -> Column:
    """The seeded digest that orders documents within a source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source in, one out."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    asked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everyone = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    levels = asked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = levels.withColumn(
        "water", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everyone)
    ).withColumn("clamped", ~F.coalesce(F.max("fits").over(by_level.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return water.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, **rates) -> DataFrame:
    """What each source gives, from rows ``source, size, ticket``: a staged table of one row per source.

    Columns: ``source, source_size, target, whole`` (repetitions of every document),
    ``cut`` (the digest bucket in which the fractional repetition ends) and ``left``
    (words of it that remain for that bucket).
    """
    buckets = stage(
        sized.groupBy("source", F.substring("ticket", 1, 3).alias("bucket")).agg(F.sum("size").alias("size")), "buckets"
    )
    targets = water_fill(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), **rates)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long")
    )
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    run = buckets.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    joined = run.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(F.col("source")))
    ends = (F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("size"))
    keys = ["source", "source_size", "target", "whole"]
    return stage(
        joined.groupBy(*keys).agg(
            F.coalesce(F.min(F.when(ends, F.col("bucket"))), F.lit(AFTER_ALL)).alias("cut"),
            F.coalesce(F.min(F.when(ends, F.col("extra") - F.col("before"))), F.lit(0)).alias("left"),
        ),
        "mix",
    )


def take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``sized`` (with ``source, size, ticket``) and ``source_size, target, taken`` under a plan."""
    plan = plan.withColumnRenamed("source", "plan_source")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("bucket", F.substring("ticket", 1, 3))
    sure = rows.filter("bucket != cut").withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    order = W.partitionBy("source").orderBy("ticket", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = rows.filter("bucket = cut").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    out = sure.unionByName(last).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.select(*sized.columns, "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_sizes(docs: DataFrame, seed: str = SEED, **rates) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``doc_id, text, source``.

    A null text has size 0; null is a source of its own, the last; rows of one id are
    separate documents; other columns are ignored; an empty table gives an empty result.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), ticket(F.col("doc_id"), seed).alias("ticket")), "sized")
    return take(sized, mix_plan(sized, **rates)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = SEED, **rates) -> DataFrame:
    """The mixed corpus: the input's columns, a row for every repetition.

    Whole repetitions carry the whole text.  The one document a source takes in part
    carries its first words, joined by single spaces, and its own ``n_chars`` if the
    input has that column.
    """
    columns = docs.columns
    # input columns travel in a struct, so none can clash with a name used here
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "source", "doc_id", "text", word_count(F.col("text")).alias("size"), ticket(F.col("doc_id"), seed).alias("ticket"))
    plan = mix_plan(stage(sized.select("source", "size", "ticket"), "sized"), **rates)
    taken = take(sized, plan)
    # an empty document costs no words and is kept once
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = taken.withColumn("words", F.explode(copies))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    text = F.when(F.col("words") < 0, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest("words", F.lit(1))), " "))
    out = {c: F.col("row")[c] for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("words") < 0, F.col("row")["n_chars"]).otherwise(F.length(text).cast("long"))
    return rows.select(*[out[c].alias(c) for c in columns])
