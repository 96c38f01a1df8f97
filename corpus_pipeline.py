"""The corpus pipeline: rules, near duplicates, privacy, mixing, packing.

Each stage reads what the stage before wrote, works on all of it, and all but the last
return the columns of ``documents``.  What a stage has staged for itself is deleted when the
next one begins, as its result has been written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.staging import delete, drop_staged, noted, stage
from graphloom.llm import minhash, mixing, packing, privacy, rules


#: Documents are near duplicates from this share of common five-word shingles on, in percent.
NEAR_PERCENT = 80


def _carried(docs: DataFrame, *working: str) -> DataFrame:
    """``docs`` as a struct ``carried`` beside the columns that a stage works on, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"), *working)


def _restored(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the carried documents, those in ``changed`` as given."""
    return rows.select(*[changed.get(c, F.col("carried")[c]).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram ratio keep.

    Each row is judged by its own text; null, empty and short texts go.  Repeated rows
    and rows without an id are judged like any other; columns of any name stay as they
    are; an empty table stays empty.
    """
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    judged = rules.quality_rules(_carried(docs, "doc_id", "text"), good)
    return _restored(judged.filter("kept"), docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of rows with that id, one.

    Every row is a document of its own, whether its id is repeated or missing; a row
    without an id stays only where no row of its group has one.  Rows without words link
    with nothing and stay.  Columns of any name stay; an empty table stays empty.
    """
    keyed = stage(_carried(docs, "doc_id", "text").withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    groups = minhash.near_duplicates(keyed, percent=NEAR_PERCENT, id_col="row_key").select("row_key", "component_id")
    first = F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    kept = groups.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(first.alias("row_key"))
    return _restored(keyed.join(kept.select("row_key"), "row_key", "left_semi"), docs.columns)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind, with ``n_chars``, if there is one, of the text as masked.

    A null text stays null and an empty one empty.  Repeated rows are masked alike,
    rows without an id like any other; columns of any name stay; an empty table stays
    empty.
    """
    found = privacy.annotate(_carried(docs, "text"), keep=["carried", "text"])
    found = found.withColumn("text", privacy.masked("text", "spans"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("carried")["n_chars"])
    return _restored(found, docs.columns, **changed)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repetition that the mix takes, as a row.

    A null source is a source of its own; a null or empty text has no words and stays
    once; repeated rows are documents of their own; columns of any name stay; an empty
    table stays empty.
    """
    return mixing.mix_documents(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every repetition and its place in a sequence.

    A null or empty text is one piece, its end id; rows that repeat an id, or have
    none, are documents of their own; columns other than ``doc_id`` and ``text`` do not
    matter; an empty table gives an empty result.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


#: Tables that a stage has staged for itself, by application and stage.
_left: dict[tuple[str, int], list[str]] = {}


def _tidied(number: int, step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage of this number, after what the one before it left is deleted, but for tables that ``docs`` still reads."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _left.pop((app, number - 1), [])
        read = docs.inputFiles() if left else []
        for path in left:
            if not any(path.rsplit("/", 1)[-1] in f for f in read):
                delete(spark, path)
        with noted() as paths:
            out = step(spark, docs, sf_dir)
        _left[app, number] = paths
        return out

    return run


_STEPS: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("PII", privacy_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

STAGES = [(name, _tidied(k, step)) for k, (name, step) in enumerate(_STEPS)]

#: Hashing, tokenising and pattern search are not SQL; tests hold each stage against its operator's results and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
