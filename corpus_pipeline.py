"""A training corpus in five stages; each takes the documents that the stage before kept and returns documents again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemniscate.llm import decontaminate, line_dedup, near_copies, pieces, toxicity
from lemniscate.llm.common import long_id, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew (null texts keep theirs)."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, scores below 0.7."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more in five documents and more stay in the largest doc_id only."""
    return documents(line_dedup.without_repeated_lines(docs.select(*COLUMNS)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near copies: five-word shingles of Jaccard similarity 0.8 or more.

    Texts without a word, which say nothing, aren't a group: all stay, as do rows whose id is no whole number.  Of rows that
    share an id only those whose own text is a near copy go; rows that repeat both id and text are one document and stay.
    """
    said = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(*COLUMNS)
    near = near_copies.near_copies(rows.where(long_id().isNotNull() & said).select("doc_id", "text"))
    gone = near.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    own = (long_id() == F.col("gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("gone_row"))
    return rows.join(gone, own, "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that ten-word windows of the benchmark cover."""
    return documents(decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def with_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("pieces", with_pieces),
]
#: Learned scores, XXH64 fingerprints and piece ids have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each stage's documents written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
