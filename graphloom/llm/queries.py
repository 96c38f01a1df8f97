"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chaining, chat, divergence, extraction, lines, minhash, mixing, packing, privacy, projection, rules, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_exact_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op5_contextual_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.annotate(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [privacy.count_of(kind, "base").alias(f"n_{kind}") for kind in privacy.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(privacy.joined_spans("base"), 256).alias("base_sha256"), privacy.joined_spans("spans").alias("spans"))


def op6_block_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"), extraction.fit())


def op7_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts hold another template's control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that aren't held out; scores all documents."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lines.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return lines.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    judged = rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_sorted_projections": op1_sorted_projections,
    "op2_bbit_minhash": op2_bbit_minhash,
    "op3_exact_complement": op3_exact_complement,
    "op4_water_filling": op4_water_filling,
    "op5_contextual_extraction": op5_contextual_extraction,
    "op6_block_field": op6_block_field,
    "op7_prefix_target": op7_prefix_target,
    "op8_line_field": op8_line_field,
    "op9_collinear_chaining": op9_collinear_chaining,
    "op10_ngram_ratio": op10_ngram_ratio,
    "op11_count_cells": op11_count_cells,
    "op12_spectrum_slicing": op12_spectrum_slicing,
    "op13_transaction_assembly": op13_transaction_assembly,
}
