"""Continuous ingestion of formula shards: new lines are normalised, hashed and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import clean, text_hash
from ..sources.readers import SHARD


def shard_stream(spark: SparkSession, path: str) -> DataFrame:
    """(formula_id, visual_id, latex_norm, hash) of unflagged formulas, as shards arrive."""
    rows = spark.readStream.schema(SHARD).option("sep", "\t").option("header", True).csv(path)
    rows = rows.where(F.col("formula").isNotNull() & ~F.contains(F.coalesce("issue", F.lit("")), F.lit("d")))
    norm = rows.select(F.col("id").alias("formula_id"), "visual_id", clean("formula").alias("latex_norm"))
    return norm.withColumn("hash", text_hash(F.col("latex_norm")))


def start(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append to the table at out until all present shards are in; the file sink writes each batch exactly once."""
    return shard_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
