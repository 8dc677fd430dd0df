"""A bigram index on disk in impact order, with block maxima: searches skip the blocks that can't reach a query's k-th score.

A document's postings all have the impact 1 / sqrt(length), so impact order is length order: documents are sorted by length
and cut into blocks of `size`, and a block's shortest document gives its greatest impact.  A block also keeps the union
of its documents' paths, so for a query the weights of its paths there, times that impact, bound every score in it.

Layout under one path: `documents` (size_class, block, id, len, paths), a partition for each power of two of the length;
`blocks` (size_class, block, n, low, paths); `terms` (path, df, idf); `columns`, those of `documents`.  The corpus is tokenised once, when the index is
written; searches read the index only, and of `documents` only the classes that hold an open block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved
from .index import bigram_paths
from .search import best_rows, top_k

#: Scores agree to nine digits, so a bound this much below a threshold is still opened.
SLACK = 1e-8


@dataclass
class BlockIndex:
    documents: DataFrame
    blocks: DataFrame
    terms: DataFrame


def write_block_index(docs: DataFrame, id_col: str, text: Column, path: str, size: int = 64) -> BlockIndex:
    """Build the index of (id_col, text) at path; documents without a path count in N only."""
    spark = docs.sparkSession
    rows = saved(bigram_paths(docs, id_col, text).select("id", F.array_distinct("paths").alias("paths"), F.size("paths").cast("long").alias("len")))
    n = rows.count()
    idf = F.log10(F.lit(n) / (F.col("df") + 1))
    rows.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("df")).withColumn("idf", idf).write.parquet(f"{path}/terms")
    log = F.floor(F.log2("len")).cast("int").alias("size_class")
    ordered = rows.where("len > 0").select(log, "id", "len", "paths").repartitionByRange("size_class", "len", "id").sortWithinPartitions("size_class", "len", "id")
    at = F.monotonically_increasing_id()  # partition and place in it: blocks follow the order and never cross partitions
    blocks = ordered.withColumn("_at", at).withColumn("block", F.shiftright("_at", 33) * (1 << 33) + F.call_function("div", F.col("_at") % (1 << 33), F.lit(size)))
    blocks = blocks.select("block", "id", "len", "paths", "size_class")
    blocks.write.partitionBy("size_class").parquet(f"{path}/documents")
    blocks.limit(0).write.parquet(f"{path}/columns")  # for an index without documents, which has no partition
    union = F.array_distinct(F.flatten(F.collect_list("paths"))).alias("paths")
    stored = spark.read.schema(blocks.schema).parquet(f"{path}/documents")
    stored.groupBy("size_class", "block").agg(F.count("*").alias("n"), F.min("len").alias("low"), union).write.parquet(f"{path}/blocks")
    return load_block_index(spark, path)


def load_block_index(spark: SparkSession, path: str) -> BlockIndex:
    columns = spark.read.parquet(f"{path}/columns").schema
    return BlockIndex(spark.read.schema(columns).parquet(f"{path}/documents"), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))


class Weights:
    """A chunk of queries: a row for each of their paths, a column for each query."""

    def __init__(self, held: list):
        self.qids = [r.qid for r in held]
        self.paths = sorted({t.path for r in held for t in r.terms})
        place = {p: i for i, p in enumerate(self.paths)}
        self.w, self.has = np.zeros((len(place), len(held))), np.zeros((len(place), len(held)), np.float32)
        for c, r in enumerate(held):
            for t in r.terms:
                self.w[place[t.path], c], self.has[place[t.path], c] = t.w, 1

    def sets(self, lists: pa.Array) -> np.ndarray:
        """A row of 0 and 1 over the paths for each list."""
        number = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(self.paths, pa.string())), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = np.zeros((len(lists), len(self.paths)), np.float32)
        out[row[number >= 0], number[number >= 0]] = 1
        return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def search_chunk(held: list, index: BlockIndex, k: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """The run of one chunk of queries, and (qid, scored): how many documents each query was compared with."""
    spark = index.blocks.sparkSession
    weights = spark.sparkContext.broadcast(Weights(held))
    ids = dict(index.documents.dtypes)["id"]

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        own = weights.value
        return (own.sets(batch.column("paths")).astype(float) @ np.maximum(own.w, 0)) / np.sqrt(batch.column("low").to_numpy())[:, None]

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bound = bounds(batch)
            best = np.argsort(-bound, axis=0, kind="stable")[:seeds]
            q = np.tile(np.arange(bound.shape[1]), len(best))
            rows = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *[batch.column(c).take(pa.array(rows)) for c in ("size_class", "block", "n")], pa.array(bound[rows, q])], names=["q", "size_class", "block", "n", "bound"])

    def scored(asked: DataFrame) -> DataFrame:
        """k best of each query among the documents of its blocks (q, size_class, block)."""
        classes = [r[0] for r in asked.select("size_class").distinct().collect()]  # at most one for each bit of a length
        asks = asked.groupBy("block").agg(F.collect_list("q").alias("asks"))
        rows = index.documents.where(F.col("size_class").isin(classes)).join(asks, "block").select("id", "len", "paths", "asks")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = weights.value
            for batch in sliced(batches):
                m, asks = own.sets(batch.column("paths")), batch.column("asks")
                wanted = np.zeros((batch.num_rows, len(own.qids)), bool)
                wanted[np.repeat(np.arange(batch.num_rows), pc.list_value_length(asks).to_numpy(zero_copy_only=False)), asks.flatten().to_numpy()] = True
                scores = (m.astype(float) @ own.w) / np.sqrt(batch.column("len").to_numpy())[:, None]
                names = batch.column("id").to_pylist()
                r, c = best_rows(scores, names, k, wanted & (m @ own.has > 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column("id").take(pa.array(r)), pa.array(scores[r, c])], names=["q", "doc_id", "score"])

        return rows.mapInArrow(score, f"q int, doc_id {ids}, score double")

    found = index.blocks.select("size_class", "block", "n", "low", "paths").mapInArrow(promising, "q int, size_class int, block long, n long, bound double")
    first = saved(top_k(found.select(F.col("q").alias("qid"), "size_class", "n", F.col("block").alias("doc_id"), F.col("bound").alias("score")), seeds).select(F.col("qid").alias("q"), "size_class", "n", F.col("doc_id").alias("block")))
    near = saved(scored(first))
    ranked = top_k(near.withColumnRenamed("q", "qid"), k).where(F.col("rank") == k)
    known = {r.qid: r.score for r in ranked.select("qid", "score").collect()}  # one number for each query of the chunk
    least = spark.sparkContext.broadcast(np.array([known.get(q, -np.inf) for q in range(len(held))]) - SLACK)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, q = np.nonzero(bounds(batch) >= least.value)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *[batch.column(c).take(pa.array(row)) for c in ("size_class", "block", "n")]], names=["q", "size_class", "block", "n"])

    reach = index.blocks.select("size_class", "block", "n", "low", "paths").mapInArrow(reaching, "q int, size_class int, block long, n long")
    rest = saved(reach.join(first.select("q", "block"), ["q", "block"], "left_anti"))
    names = spark.createDataFrame([(c, r.qid) for c, r in enumerate(held)], f"q int, qid {held[0].kind}")
    run = near.union(scored(rest)).join(F.broadcast(names), "q").select("qid", "doc_id", "score")
    effort = first.select("q", "n").union(rest.select("q", "n")).groupBy("q").agg(F.sum("n").alias("scored")).join(F.broadcast(names), "q").select("qid", "scored")
    return run, effort


def block_search(queries: DataFrame, id_col: str, text: Column, index: BlockIndex, k: int, seeds: int = 8, chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """Sum over the query's distinct paths of its count * idf, by the root of the document's length: the k best of each
    query, and how many documents each was compared with.

    A query first meets the `seeds` blocks of the highest bounds, at least k documents; their k-th score is its threshold,
    and then only blocks whose bound reaches it are opened.  Queries go in chunks, whose weights and thresholds are broadcast:
    as many numbers as a chunk has queries times paths.
    """
    kind = dict(queries.dtypes)[id_col]
    terms = bigram_paths(queries, id_col, text).select(F.col("id").alias("qid"), F.explode("paths").alias("path")).groupBy("qid", "path").agg(F.count("*").alias("times"))
    weighted = terms.join(index.terms, "path").select("qid", F.struct("path", (F.col("times") * F.col("idf")).alias("w")).alias("term"))
    rows = weighted.groupBy("qid").agg(F.collect_list("term").alias("terms")).withColumn("kind", F.lit(kind))
    parts, held = [], []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == chunk:
            parts, held = [*parts, search_chunk(held, index, k, seeds)], []
    parts = [*parts, search_chunk(held, index, k, seeds)] if held else parts
    if not parts:
        empty = index.documents.select(F.lit(None).cast(kind).alias("qid"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
        return top_k(empty, k), empty.select("qid", F.lit(0).cast("long").alias("scored"))
    run, effort = (reduce(DataFrame.union, side) for side in zip(*parts))
    return top_k(run, k), effort
