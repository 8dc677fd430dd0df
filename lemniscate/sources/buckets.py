"""Index tables in hash buckets of their key: joins, lookups and upserts read them as they lie, without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path


def _save(rows: DataFrame, key: str, buckets: int, table: str, path: str | None) -> DataFrame:
    spark = rows.sparkSession
    rows.write.format("parquet").option("path", path or shared_path(spark, table)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def table_name(prefix: str = "index") -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest `order` of each key that isn't null, found by an aggregate: a key with very many rows is one
    partial row a task, where a window would bring them together."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def write_buckets(rows: DataFrame, key: str, buckets: int, table: str, path: str | None = None) -> DataFrame:
    """rows as a table of `buckets` files, each sorted by key.  Choose the number so that a bucket fits in a task (256 MB, say)
    as the table grows.  path: a shared folder, else one in the checkpoint folder."""
    return _save(rows.repartition(buckets, key), key, buckets, table, path)


def buckets_of(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} has no buckets")
    return int(rows[0].data_type)


def open_buckets(spark: SparkSession, path: str, table: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A bucketed folder that another session wrote, under a name in this one; schema, key and buckets as they were written."""
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def upsert_buckets(spark: SparkSession, table: str, batch: DataFrame, key: str, order: str, into: str, path: str | None = None) -> DataFrame:
    """The table `into`: the rows of `table`, those whose key the batch has replaced by the batch's newest row of that key, and
    the batch's other keys.  Both tables have the same columns; a batch's rows without a key name nothing and stay out.

    Only the batch is shuffled, to the table's buckets; each task then writes the bucket that it read.  `table` stays as it is,
    so that readers and a run that fails lose nothing.
    """
    held, n = spark.table(table), buckets_of(spark, table)
    new = newest(batch.select(*held.columns), key, order).withColumnsRenamed({c: f"_{c}" for c in held.columns})
    both = held.join(new.hint("merge"), F.col(key) == F.col(f"_{key}"), "full_outer")
    come = F.col(f"_{key}").isNotNull()
    return _save(both.select(*[F.when(come, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in held.columns]), key, n, into, path)
