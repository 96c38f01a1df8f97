"""Similarity graphs of many clusters from their alignments and structure profiles.

``aligned`` has ``cluster, id, seq``, gapped strings of one length in each cluster;
``profiles`` ``id, indx, coil_prob, helix_prob, sheet_prob``; ``matrix`` ``a, b, value``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.columns import cluster_hash
from graphloom.functions.staging import stage
from graphloom.operators.similarity import GAP_EXTEND, GAP_OPEN, alignment_scores, profile_scores, trimmed_columns, with_final_scores
from graphloom.sources import store

# The shares of gaps that are tried, strictest first.
TRIMS = (0.5, 0.75, 0.9, 0.95, "clean")
PARTS = ["coil_prob", "helix_prob", "sheet_prob"]


def _residues(aligned: DataFrame) -> DataFrame:
    return aligned.select("cluster", "id", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "residue"))


def trimmed(aligned: DataFrame, trims: Iterable[float | str] = TRIMS) -> DataFrame:
    """``cluster, id, seq`` with the columns that the first usable trim leaves."""
    kept = _residues(aligned).join(trimmed_columns(aligned, trims, ["cluster"]), ["cluster", "pos"])
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "residue"))), lambda x: x["residue"])
    return kept.groupBy("cluster", "id").agg(F.array_join(letters, "").alias("seq"))


def placed_profiles(profiles: DataFrame, aligned: DataFrame, trims: Iterable[float | str] = TRIMS) -> DataFrame:
    """``cluster, id, indx`` and the profile's parts, moved to the columns of the alignment.

    The k-th row of a profile goes to the column of the k-th residue; rows whose column is
    trimmed are dropped, and the others keep the number of the untrimmed column.
    """
    real = _residues(aligned).filter("residue != '-'")
    real = real.withColumn("k", F.row_number().over(W.partitionBy("cluster", "id").orderBy("pos")))
    real = real.join(trimmed_columns(aligned, trims, ["cluster"]), ["cluster", "pos"], "left_semi")
    rows = profiles.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("indx"))).drop("indx")
    return real.select("cluster", "id", "k", F.col("pos").alias("indx")).join(rows, ["id", "k"]).select("cluster", "id", "indx", *PARTS)


def graphs(aligned: DataFrame, profiles: DataFrame, matrix: DataFrame, trims: Iterable[float | str] = TRIMS, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> DataFrame:
    """``cluster, seq1 < seq2, subsmat, psi, raw_score, score`` of every two members of each cluster.

    Trimmed strings are scored by ``matrix``, profiles by the columns that they share, and
    both are scaled within the cluster.  A cluster of one member has no edges; a pair of
    which one has no profile has no ``psi`` but 0.
    """
    strings = stage(trimmed(aligned, trims), "trimmed")
    other = strings.select("cluster", F.col("id").alias("id2"), F.col("seq").alias("seq2"))
    pairs = strings.withColumnsRenamed({"id": "id1", "seq": "seq1"}).join(other, "cluster").filter("id1 < id2")
    key = F.struct("cluster", F.col("id1").alias("seq1"), F.col("id2").alias("seq2")).alias("pair")
    subsmat = alignment_scores(pairs.select(key, "seq1", "seq2"), matrix, gap_open, gap_extend).select("pair.*", F.col("score").alias("subsmat"))
    own = lambda i: F.struct("cluster", F.col(i).alias("id"))
    placed = stage(placed_profiles(profiles, aligned, trims).select(own("id").alias("id"), "indx", *PARTS), "placed")
    psi = profile_scores(pairs.select(own("id1").alias("seq1"), own("id2").alias("seq2")), placed)
    psi = psi.select(F.col("seq1.cluster").alias("cluster"), F.col("seq1.id").alias("seq1"), F.col("seq2.id").alias("seq2"), F.coalesce("psi", F.lit(0.0)).alias("psi"))
    scored = stage(subsmat.join(psi, ["cluster", "seq1", "seq2"]), "scored")
    return with_final_scores(scored, ["cluster"])


def stored_graphs(aligned: DataFrame, profiles: DataFrame, matrix: DataFrame, path: str, **more) -> DataFrame:
    """As :func:`graphs`, but a cluster whose members the store below ``path`` has seen together is read from there.

    The store's key is the digest of a cluster's sorted ids, so a cluster is found again
    under any name and in any run.  What is new is built once and added.
    """
    named = stage(aligned.groupBy("cluster").agg(cluster_hash(F.collect_list(F.col("id").cast("string"))).alias("hash")), "hashes")
    known = store.read(aligned.sparkSession, path)
    fresh = named if known is None else named.join(known.select("hash").distinct(), "hash", "left_anti")
    # of clusters with the same members one is built
    fresh = stage(fresh.groupBy("hash").agg(F.min("cluster").alias("cluster")), "fresh")
    if not fresh.isEmpty():
        built = graphs(aligned.join(fresh, "cluster", "left_semi"), profiles, matrix, **more)
        store.append(built.join(fresh, "cluster").drop("cluster"), path)
    rows = store.read(aligned.sparkSession, path)
    return named.join(rows, "hash").drop("hash")
