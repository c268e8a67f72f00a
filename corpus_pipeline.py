"""A corpus pipeline over documents: quality classifier, exact dedup, near dedup, mixing, packing.

run() applies STAGES to a folder's documents, writing each stage's result as Parquet and reading it again.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisieve.llm import exact_dedup, mixing, near_dedup, packing, quality
from apisieve.llm.common import clear_scratch, materialize, read, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1; it learns from the labels' training rows, as in op6.

    Null, empty and blank texts get the score of no evidence and go or stay together; very long ones are scored whole. Repeated
    rows have one score. Without usable labels every score is 0.5, and all stay. Other columns than documents' are dropped.
    """
    clear_scratch(spark)
    docs = _columns(docs)
    scored = quality.quality(docs, read(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs and a number for each row, written once: repeated doc_ids are told apart by it, and all that a stage reads has the same numbers."""
    return materialize(_columns(docs).withColumn("rid", F.monotonically_increasing_id()), "numbered")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one row of each group of equal texts that stays.

    Null, empty and blank texts are equal, so one of them stays, the longest. Ties go to the smallest doc_id (null last),
    and of rows that repeat in full one stays. Texts count whole at any length; other columns than documents' are dropped. No rows give none.
    """
    clear_scratch(spark)
    rows = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows, rid=F.col("rid")).where("kept").select("rid")
    return rows.join(kept, "rid", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id (null last).

    Texts without words (null, empty, blank) are copies only of equal ones. Rows that repeat in full leave one. Texts count
    whole at any length; other columns than documents' are dropped. No rows give none.
    """
    clear_scratch(spark)
    return near_dedup.keep_one(_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each repetition of a document; that of a fractional one has the first words only, and their n_chars.

    Texts without words (null, empty, blank) have no share and go. A null source is a source of its own. Repeated rows count
    each; ties in the seeded order go by doc_id and size. Very long texts are repeated or cut like others. No rows give none.
    """
    clear_scratch(spark)
    docs = _numbered(docs)
    taken = mixing.mix(docs, carry=("rid",)).where("taken > 0").select(F.col("rid").alias("row"), "size", "taken")
    rows = docs.join(taken, F.col("rid") == F.col("row"))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(0), whole)
    rows = rows.withColumn("cut", F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)), F.lit(1), F.col("cut")), "")
    text = F.when(F.col("cut") > 0, part).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the mix's documents; repetitions of one never share a bin.

    Texts without words get bin -1. A null source is a source of its own. Texts of more words than a bin holds are cut into
    several pieces. Ties go by cluster, source and hash. No rows give none; other columns are ignored.
    """
    clear_scratch(spark)
    return packing.pack(_columns(docs)).drop("rid")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_bins),
]

#: A trained classifier and best-fit packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "stage", keep=True)
        done.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
