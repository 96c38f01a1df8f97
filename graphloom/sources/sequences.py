"""FASTA, profile, score and forward-score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "seq1 string, seq2 string, subsmat double, psi double, raw_score double, score double"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, description, seq`` of FASTA files; sequences upper-cased, other characters than letters, ``*`` and ``-`` dropped."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    seq = F.regexp_replace(F.upper(F.regexp_replace("value", r"^[^\n]*\n?", "")), "[^A-Z*-]", "")
    return records.select(
        F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\s*\S+", "")).alias("description"), seq.alias("seq")
    ).filter(F.length("seq") > 0)


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """Records as text rows."""
    return sequences.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))


def malformed_ids(sequences: DataFrame, separator: str = "-") -> DataFrame:
    """Ids that don't split into a taxon and a name, and ids that occur twice."""
    from graphloom.functions.columns import well_formed

    twice = sequences.groupBy("id").agg(F.count("*").alias("n"))
    return twice.filter((F.col("n") > 1) | ~well_formed(F.col("id"), separator)).select("id")


def _columns(spark: SparkSession, path: str, names: list[tuple[str, str]]) -> DataFrame:
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    words = F.split(F.trim("value"), r"\s+")
    kept = rows.filter(~F.col("value").rlike(r"^\s*(#|$)")).select("file", words.alias("w"))
    return kept.select("file", *[F.col("w")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``id, indx, aa, ss, coil_prob, helix_prob, sheet_prob`` of profile files named by id."""
    names = [("indx", "int"), ("aa", "string"), ("ss", "string"), ("coil_prob", "double"), ("helix_prob", "double"), ("sheet_prob", "double")]
    rows = _columns(spark, path, names)
    return rows.withColumn("id", F.regexp_replace("file", r"\.ss2$", "")).select("id", *[n for n, _ in names])


def read_forward_scores(spark: SparkSession, path: str) -> DataFrame:
    """``hmm_id, rec_id, fwd_raw`` of score listings named by model."""
    names = [("rec_id", "string"), ("fwd_raw", "double"), ("back_raw", "double"), ("fwd_bits", "double"), ("back_bits", "double")]
    rows = _columns(spark, path, names)
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("hmm_id"), "rec_id", "fwd_raw")


def read_scores(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA, separator: str = ",") -> DataFrame:
    """Edges of files without a header."""
    return spark.read.schema(schema).csv(path, sep=separator)


def write_scores(edges: DataFrame, path: str, separator: str = ",") -> None:
    edges.write.csv(path, sep=separator, header=False)


def write_fasta(sequences: DataFrame, path: str) -> None:
    """Records of ``id, seq`` as FASTA; with a ``description`` that follows the id."""
    about = F.coalesce("description", F.lit("")) if "description" in sequences.columns else F.lit("")
    head = F.rtrim(F.concat(F.lit(">"), F.col("id"), F.lit(" "), about))
    sequences.select(F.concat(head, F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value")).write.text(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Rows of profiles, separated by blanks and in order of their index, in a folder for each id.

    A profile is sorted in the task that writes it; one is as long as its sequence.
    """
    names = ["indx", "aa", "ss", "coil_prob", "helix_prob", "sheet_prob"]
    line = F.concat_ws(" ", *[F.col(n).cast("string") for n in names])
    dealt = profiles.repartition("id").sortWithinPartitions("id", "indx")
    dealt.select("id", line.alias("value")).write.partitionBy("id").text(path)


def by_length(sequences: DataFrame) -> DataFrame:
    """Records from the longest to the shortest, equal ones by id."""
    return sequences.orderBy(F.desc(F.length(F.regexp_replace("seq", "-", ""))), "id")
