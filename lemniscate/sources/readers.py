"""Readers of formula shards, topics, judgments and runs.  Schemas are declared; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "post_id", "thread_id", "type", "comment_id", "old_visual_id", "visual_id", "issue", "formula")])
FORMULA = T.StructType([T.StructField("formula_id", T.StringType()), T.StructField("latex", T.StringType()), T.StructField("latex_norm", T.StringType()), T.StructField("mathml_skel", T.StringType())])
WS = r"[ \t\n\r\f\x0B]"


def formula_shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab-separated shards with a header and quoted fields that may hold tabs and line ends; rows of fewer columns are left
    out.  The column `shard` names the file, for orders by shard."""
    rows = spark.read.schema(SHARD).csv(paths, sep="\t", header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, enforceSchema=True)
    return rows.where(F.col("formula").isNotNull()).withColumn("shard", F.input_file_name())


def formula_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lenient form: each line trimmed and cut at tabs, quotes kept as they are; more than eight fields, and no header."""
    p = F.split(F.regexp_replace("value", f"^{WS}+|{WS}+$", ""), "\t", -1)
    rows = spark.read.text(paths).select(p.alias("p")).where((F.size("p") > 8) & (F.col("p")[0] != "id"))
    return rows.select(*[F.col("p")[i].alias(f.name) for i, f in enumerate(SHARD.fields)])


def two_columns(spark: SparkSession, paths: str | list[str], names: tuple[str, str] = ("id", "latex")) -> DataFrame:
    """Headerless id and text without quoting; rows without a second column are left out."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(paths, sep="\t", quote="").where(F.col(names[1]).isNotNull())


def qrels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qid, doc_id, rel) from four tab-separated columns; rows whose relevance is no integer are left out; of a repeated pair
    the last line of the file stays."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("qid", "iteration", "doc_id", "rel")])
    rows = spark.read.schema(schema).csv(paths, sep="\t", quote="").withColumn("rel", F.expr("try_cast(rel AS INT)")).where("rel is not null and doc_id is not null")
    rows = rows.select("qid", "doc_id", "rel", F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("at", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.col("line").desc()))).where("at = 1").select("qid", "doc_id", "rel")


def trec_run(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qid, doc_id, rank, score) from white-space-separated run files; lines of fewer than five fields are left out."""
    p = F.split(F.regexp_replace("value", f"^{WS}+|{WS}+$", ""), f"{WS}+")
    rows = spark.read.text(paths).select(p.alias("p")).where(F.size("p") >= 5)
    return rows.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.expr("try_cast(p[3] AS INT)").alias("rank"), F.expr("try_cast(p[4] AS DOUBLE)").alias("score"))


def json_map(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(key, value) of a file that is one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("key", "value"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def topics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(query_id, formula_id, latex, title, question, tags) of Topic elements."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_number", "Formula_Id", "Latex", "Title", "Question", "Tags")])
    rows = spark.read.format("xml").option("rowTag", "Topic").schema(schema).load(paths)
    return rows.where(F.col("_number").isNotNull()).select(F.col("_number").alias("query_id"), F.col("Formula_Id").alias("formula_id"), F.col("Latex").alias("latex"), F.col("Title").alias("title"), F.col("Question").alias("question"), F.col("Tags").alias("tags"))


def id_map(rows: DataFrame, ids: str) -> DataFrame:
    """(position, id) of an array of ids: the form in which positional vector files name their rows."""
    return rows.select(F.posexplode(ids).alias("position", "id"))


def raw_vectors(spark: SparkSession, paths: str | list[str], dims: int) -> DataFrame:
    """(position, embedding) of files of fixed-width rows: dims little-endian float32 numbers each, without a header.

    Positions go on from file to file in the order of paths; join them with id_map.  Spark splits each file at row borders, on
    any file system that it reads, so a large file is many tasks; a first pass over the splits counts their rows.  A file
    whose length is no multiple of a row is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    width, before = 4 * dims, 0
    parts = [spark.createDataFrame([], "position long, row binary")]
    for path in paths:  # a handful of files
        length = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if length % width:
            raise ValueError(f"{path} has {length} bytes, which are no rows of {dims} numbers")
        if length:
            rows = spark.sparkContext.binaryRecords(path, width).zipWithIndex()
            parts.append(spark.createDataFrame(rows.map(lambda r, before=before: (r[1] + before, r[0])), "position long, row binary"))
        before += length // width

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("row").to_pylist()), "<f4")
            cuts = pa.array(range(0, len(flat) + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.ListArray.from_arrays(cuts, pa.array(flat))], names=["position", "embedding"])

    return reduce(DataFrame.union, parts).mapInArrow(numbers, "position long, embedding array<float>")


def latex_of(latex_norm: Column, latex: Column) -> Column:
    """The normalised text, else the raw one, else an empty text."""
    blank = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(blank(latex_norm), blank(latex), F.lit(""))


def visual_id(c: Column) -> Column:
    return F.trim(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("q_"), F.lit("")))


def with_topic_alias(rows: DataFrame, names: DataFrame, key: str, prefix: str = "B.") -> DataFrame:
    """rows joined to names on the id itself, else on the id with the prefix."""
    own = names.withColumnRenamed("qid", "_qid")
    plain = rows.join(own, F.col(key) == F.col("_qid"), "left")
    missing = plain.where(F.col("_qid").isNull()).select(*rows.columns)
    return plain.where(F.col("_qid").isNotNull()).union(missing.join(own, F.concat(F.lit(prefix), F.col(key)) == F.col("_qid"), "left")).withColumnRenamed("_qid", "matched_qid")


def rows_of_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a JSON-lines or other table whose id is asked for: a semi join, so that nothing is read into the driver."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
