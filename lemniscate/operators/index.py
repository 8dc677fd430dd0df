"""Indexes as tables: postings, document lengths, inverse document frequencies, hash buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import saved


@dataclass
class PathIndex:
    """postings (path, id[, tf]), lengths (id, len), idf (path, df, idf), documents (id, paths: distinct ones, len), texts (id,
    text), classes (id, n, paths): of each distinct text the least id, its documents' number and its paths with repeats."""

    postings: DataFrame
    lengths: DataFrame
    idf: DataFrame
    documents: DataFrame
    texts: DataFrame
    classes: DataFrame


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text, id: the least, n) of (id, text), so that what depends on the text alone is done once for all of its copies;
    dealt out to all cores, as tokenizers take long over few texts."""
    own = texts.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return own.repartition(texts.sparkSession.sparkContext.defaultParallelism)


def first_copies(texts: DataFrame, k: int) -> DataFrame:
    """(id, copy): the k least ids of each distinct text, id being the least of them."""
    own = W.partitionBy("text")
    first = texts.withColumn("at", F.row_number().over(own.orderBy("id"))).where(F.col("at") <= k)
    return first.select(F.min("id").over(own).alias("id"), F.col("id").alias("copy"))


def document_frequencies(classes: DataFrame) -> DataFrame:
    return classes.select("n", F.explode(F.array_distinct("paths")).alias("path")).groupBy("path").agg(F.sum("n").alias("df"))


def bigram_paths(docs: DataFrame, id_col: str, text: Column, n: int = 2) -> DataFrame:
    """(id, paths) with the token array behind a materialised projection, so the tokenizer runs once a row."""
    tokens = docs.select(F.col(id_col).alias("id"), paths.symbols(text).alias("tokens"))
    return tokens.select("id", paths.ngrams(F.col("tokens"), n).alias("paths"))


def bigram_index(docs: DataFrame, id_col: str, text: Column) -> PathIndex:
    """Distinct postings; lengths with duplicates; log10(N / (df + 1)), N counting documents without paths too."""
    rows = bigram_paths(docs, id_col, text)
    postings = rows.select("id", F.explode(F.array_distinct("paths")).alias("path"))
    lengths = rows.select("id", F.size("paths").cast("long").alias("len"))
    n = docs.agg(F.count("*").alias("n"))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    tokens = distinct_texts(texts).select("id", "n", paths.symbols(F.col("text")).alias("tokens"))
    classes = saved(tokens.select("id", "n", paths.ngrams(F.col("tokens"), 2).alias("paths")), "classes")
    idf = document_frequencies(classes).join(F.broadcast(n)).select("path", "df", F.log10(F.col("n") / (F.col("df") + 1)).alias("idf"))
    documents = rows.select("id", F.array_distinct("paths").alias("paths"), F.size("paths").cast("long").alias("len"))
    return PathIndex(postings, lengths, idf, documents, texts, classes)


def stack_index(docs: DataFrame, id_col: str, text: Column) -> PathIndex:
    """Postings with term frequency over the stack machine's paths; ln(N / (1 + df)), N being documents with a path."""
    rows = docs.select(F.col(id_col).alias("id"), paths.words(text).alias("tokens")).select("id", paths.stack_paths(F.col("tokens")).alias("paths"))
    postings = rows.select("id", F.explode("paths").alias("path")).groupBy("path", "id").agg(F.count("*").alias("tf"))
    lengths = rows.select("id", F.size("paths").cast("long").alias("len"))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    tokens = distinct_texts(texts).select("id", "n", paths.words(F.col("text")).alias("tokens"))
    classes = saved(tokens.select("id", "n", paths.stack_paths(F.col("tokens")).alias("paths")), "classes")
    n = classes.where(F.size("paths") > 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    idf = document_frequencies(classes).join(F.broadcast(n)).select("path", "df", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))
    documents = rows.select("id", F.array_distinct("paths").alias("paths"), F.size("paths").cast("long").alias("len"))
    return PathIndex(postings, lengths, idf, documents, texts, classes)


def hash_buckets(docs: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(hash, ids, n): ids ascending."""
    return docs.groupBy(F.col(hash_col).alias("hash")).agg(F.sort_array(F.collect_list(id_col)).alias("ids"), F.count("*").alias("n"))


def bucket_stats(docs: DataFrame, hash_col: str) -> DataFrame:
    """One row: buckets, average and largest size, share of single buckets, share of rows beyond a bucket's first."""
    sizes = docs.groupBy(hash_col).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_buckets"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("single_share"), (1 - F.count("*") / F.sum("n")).alias("collision_rate")
    )


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key: an upsert of a batch."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a declared order."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def without_flagged(rows: DataFrame, flag: str = "d", column: str = "issue") -> DataFrame:
    return rows.where(~F.contains(F.coalesce(column, F.lit("")), F.lit(flag)))


def long_enough(rows: DataFrame, column: str, least: int = 3) -> DataFrame:
    return rows.where(F.length(F.coalesce(column, F.lit(""))) >= least)
