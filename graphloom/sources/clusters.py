"""Cluster files: one cluster per line, with or without a name and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``cluster, score, pos, id`` of lines ``value``, beside their other columns; cluster and score are null where a line has none."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.select(*kept, words.alias("w")).filter(F.size("w") > 0)
    named = F.col("w")[0].rlike("^group_")
    scored = named & F.coalesce(F.get("w", F.lit(1)).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$"), F.lit(False))
    first = F.when(scored, 3).when(named, 2).otherwise(1)
    return rows.select(
        *kept, F.when(named, F.col("w")[0]).alias("cluster"), F.when(scored, F.get("w", F.lit(1)).cast("double")).alias("score"),
        F.posexplode(F.slice("w", first, F.size("w"))).alias("pos", "id"),
    )


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``line, cluster, score, pos, id`` of a cluster file; unnamed clusters are told apart by their line."""
    return parsed_lines(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def group_lines(members: DataFrame, min_size: int = 1, max_size: int | None = None, names: list[str] | None = None) -> DataFrame:
    """``cluster, size, ids`` of clusters within the sizes and, if given, the names (case does not count)."""
    rows = members.groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("ids")).filter(F.col("size") >= min_size)
    if max_size is not None:
        rows = rows.filter(F.col("size") <= max_size)
    return rows if names is None else rows.filter(F.lower("cluster").isin([n.lower() for n in names]))


def final_lines(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines ``name, score, ids`` by falling size: the final cluster file."""
    rows = group_lines(members).join(scores, "cluster")
    line = F.concat_ws("\t", "cluster", F.round("score", 4).cast("string"), F.array_join("ids", "\t"))
    return rows.orderBy(F.desc("size"), "cluster").select(line.alias("value"))


def write_raw_clusters(members: DataFrame, path: str) -> None:
    """One line of sorted, tab-joined ids per cluster; rows without an id do not count."""
    ids = members.filter("id is not null").groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    ids.select(F.array_join("ids", "\t").alias("value")).write.text(path)


def exported_records(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """``cluster, value``: a FASTA record of each member that ``sequences(id, description, seq)`` knows, described as there.

    With aligned sequences this is the export of alignments.  A missing description or
    sequence is an empty one; members without a record have no row.
    """
    known = sequences.select("id", F.coalesce("description", F.lit("")).alias("about"), F.coalesce("seq", F.lit("")).alias("seq"))
    head = F.rtrim(F.concat(F.lit(">"), F.col("id"), F.lit(" "), F.col("about")))
    return members.select("cluster", "id").join(known, "id").select("cluster", F.concat(head, F.lit("\n"), "seq").alias("value"))


def exported_consensus(members: DataFrame, aligned: DataFrame) -> DataFrame:
    """``cluster, value``: a FASTA record per cluster of the commonest residue of each column, the smaller one of a tie."""
    letters = members.select("cluster", "id").join(aligned.select("id", "seq"), "id").select("cluster", F.posexplode(F.split("seq", "")).alias("pos", "residue"))
    counts = letters.filter("residue != ''").groupBy("cluster", "pos", "residue").agg(F.count("*").alias("n"))
    top = counts.groupBy("cluster", "pos").agg(F.min(F.struct(-F.col("n"), "residue"))["residue"].alias("residue"))
    line = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "residue"))).alias("row"))
    return line.select("cluster", F.concat(F.lit(">"), F.col("cluster"), F.lit("\n"), F.array_join(F.transform("row", lambda x: x["residue"]), "")).alias("value"))


def write_groups(exported: DataFrame, path: str) -> None:
    """A folder for each cluster of ``cluster, value``; a cluster of any size is written by as many tasks as hold it."""
    exported.select("cluster", "value").write.partitionBy("cluster").text(path)
