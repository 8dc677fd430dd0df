"""Writers of runs, training pairs and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trec_lines(run: DataFrame, tag: str, digits: int = 6) -> DataFrame:
    """One text column: qid Q0 doc_id rank score tag; a missing score is 0."""
    return run.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string(f"%.{digits}f", F.coalesce(F.col("score").cast("double"), F.lit(0.0))), F.lit(tag)).alias("value"))


def write_trec(run: DataFrame, path: str, tag: str, digits: int = 6) -> None:
    """Sorted by query and rank over all part files."""
    trec_lines(run.repartitionByRange("qid").sortWithinPartitions("qid", "rank"), tag, digits).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines {texts: [query, document], label}."""
    pairs.select(F.array("query", "document").alias("texts"), "label").write.mode("overwrite").json(path)


def write_index(table: DataFrame, path: str, *by: str) -> None:
    """An index table, ranged and sorted by its keys so that row-group statistics prune lookups."""
    out = table.repartitionByRange(*by).sortWithinPartitions(*by) if by else table
    out.write.mode("overwrite").parquet(path)


def append_missing(table: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at path doesn't hold yet; the number appended.  A run that was stopped goes on here."""
    spark = table.sparkSession
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = table.select(key).limit(0)
    new = table.join(held, key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_features(rows: DataFrame, path: str) -> None:
    """Training groups as Parquet: qid, features array<double>, label."""
    rows.select("qid", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label")).write.mode("overwrite").parquet(path)
