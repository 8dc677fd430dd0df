"""A vector index on disk: cells by k-means, product codes, and the vectors, all written once and appended to.

Each vector goes to its nearest cell and is written twice: as a code of one byte for each of `parts` sub-vectors, its
nearest centre there, and whole.  A search reads the codes only, a few bytes a vector: for a query, a table of its products with
all centres turns a code into a score by one lookup a part.  The `refine` best codes of each query are then scored exactly, and
only the cells that hold them are read.  With `probes`, codes of the nearest cells only are read, too.

Layout under one path: `codes` (cell, id, code) and `vectors` (cell, id, embedding), partitioned by `shelf`, a run of cells;
`centres` (kind, part, code, centre).  Cells grow as the root of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved
from .search import best_rows, dot, top_k


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length vectors as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(m: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """For each part (first axis of centres) and row of m the n nearest centres: (parts, rows, n)."""
    parts, _, width = centres.shape
    own = m.reshape(len(m), parts, width).transpose(1, 0, 2)
    far = (centres**2).sum(axis=2)[:, None, :] - 2 * own @ centres.transpose(0, 2, 1)
    return far.argmin(axis=2)[:, :, None] if n == 1 else np.argsort(far, axis=2, kind="stable")[:, :, :n]


def centres_of(vectors: DataFrame, parts: int, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """(parts, k, width) centres of k-means in each part.  Vectors are assigned and summed on the executors, so a round brings
    parts * k sums to the driver however many vectors there are; it begins with the k vectors of the smallest id hashes."""
    first = matrix(vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("embedding").toArrow().column("embedding").combine_chunks())
    centres = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centres)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(c.shape[:2], np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = matrix(batch.column("embedding"))
                for p, own in enumerate(nearest(m, c)[:, :, 0]):
                    np.add.at(total[p], own, m[:, p * c.shape[2] : (p + 1) * c.shape[2]])
                    n[p] += np.bincount(own, minlength=c.shape[1])
            part, code = np.nonzero(n)
            sums = total[part, code]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(code), pa.array(n[part, code]), pa.array(list(sums), pa.list_(pa.float64()))], names=["part", "code", "n", "total"])

        found = vectors.select("embedding").mapInArrow(add, "part long, code long, n long, total array<double>")
        sums = found.groupBy("part", "code").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(centres.shape[2])]).toArrow().to_pandas()
        centres[sums.part, sums.code] = sums.filter(like="t", axis=1).drop(columns=["part"], errors="ignore").to_numpy() / sums.n.to_numpy()[:, None]
        shared.unpersist()
    return centres


@dataclass
class VectorIndex:
    codes: DataFrame
    vectors: DataFrame
    cells: np.ndarray
    book: np.ndarray

    @property
    def shelves(self) -> int:
        return -(-self.cells.shape[1] // 16)


def filed(vectors: DataFrame, cells: np.ndarray, book: np.ndarray) -> DataFrame:
    """(shelf, cell, id, code, embedding) of (id, embedding)."""
    shared = vectors.sparkSession.sparkContext.broadcast((cells, book))
    kind = dict(vectors.dtypes)["id"]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, (c, b) = matrix(batch.column("embedding")), shared.value
                own, codes = nearest(m, c)[0, :, 0], nearest(m, b)[:, :, 0].T.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array((own // 16).astype(np.int32)), pa.array(own.astype(np.int32)), batch.column("id"), pa.array([x.tobytes() for x in codes]), batch.column("embedding")], names=["shelf", "cell", "id", "code", "embedding"])

    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(file, f"shelf int, cell int, id {kind}, code binary, embedding array<double>")


def append_vectors(vectors: DataFrame, index: VectorIndex, path: str) -> None:
    """Write (id, embedding) to their cells at path, next to what is there; the centres stay."""
    rows = saved(filed(vectors, index.cells, index.book))
    for name, column in (("codes", "code"), ("vectors", "embedding")):
        # rows of a cell together and in order, so that a cell is a few row groups of its shelf
        out = rows.select("shelf", "cell", "id", column).repartitionByRange("cell", "id").sortWithinPartitions("shelf", "cell", "id")
        out.write.mode("append").partitionBy("shelf").parquet(f"{path}/{name}")


def write_vector_index(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 16, codes: int = 256) -> VectorIndex:
    """The index of (id, embedding) at path; an embedding's length is a multiple of `parts`."""
    spark, rows = vectors.sparkSession, vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    if not n:
        raise ValueError("an index needs a vector at least, for its centres")
    found = {"cell": centres_of(rows, 1, cells or max(1, round(n**0.5))), "part": centres_of(rows, parts, min(codes, 256))}
    flat = [(kind, p, c, centre.tolist()) for kind, m in found.items() for p, part in enumerate(m) for c, centre in enumerate(part)]
    spark.createDataFrame(flat, "kind string, part int, code int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    append_vectors(rows, VectorIndex(rows, rows, found["cell"], found["part"]), path)
    return load_vector_index(spark, path)


def load_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("kind", "part", "code").collect()  # as many as cells and codes, never as vectors
    own = {k: np.array([r.centre for r in rows if r.kind == k]).reshape(max(r.part for r in rows if r.kind == k) + 1, -1, len(next(r.centre for r in rows if r.kind == k))) for k in ("cell", "part")}
    return VectorIndex(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), own["cell"], own["part"])


def search_vectors(queries: DataFrame, index: VectorIndex, k: int, refine: int = 0, probes: int = 0, chunk: int = 1024) -> DataFrame:
    """k best by inner product of (qid, embedding), exactly scored among the `refine` (0: 20 * k) best codes of all cells or of the
    `probes` nearest ones.  Queries go in chunks, whose lookup tables are broadcast: parts * codes numbers a query."""
    refine, out, held = refine or 20 * k, None, []
    kinds = dict(queries.dtypes)["qid"], dict(index.codes.dtypes)["id"]

    def search(held: list) -> DataFrame:
        spark = index.codes.sparkSession
        q, (parts, codes, width) = np.array([r.embedding for r in held], float), index.book.shape
        tables = np.einsum("qpw,pcw->pqc", q.reshape(len(q), parts, width), index.book)
        near = np.ones((index.cells.shape[1], len(q)), bool)
        if probes:
            near[:] = False
            order = np.argsort(-(q @ index.cells[0].T), axis=1, kind="stable")[:, :probes]
            near[order.ravel(), np.repeat(np.arange(len(q)), order.shape[1])] = True
        shared = spark.sparkContext.broadcast((tables, near, [r.qid for r in held]))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, near, qids = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    scores = np.zeros((batch.num_rows, len(qids)))
                    for p, table in enumerate(tables):
                        scores += table[:, code[:, p]].T
                    ids, cells = batch.column("id").to_pylist(), batch.column("cell").to_numpy()
                    row, col = best_rows(scores, ids, refine, near[cells])
                    yield pa.RecordBatch.from_arrays([pa.array([qids[c] for c in col]), pa.array([ids[r] for r in row]), pa.array(cells[row]), pa.array(scores[row, col])], names=["qid", "doc_id", "cell", "score"])

        shelves = sorted({int(c) // 16 for c in np.flatnonzero(near.any(axis=1))})
        found = index.codes.where(F.col("shelf").isin(shelves)).select("id", "code", "cell").mapInArrow(look_up, f"qid {kinds[0]}, doc_id {kinds[1]}, cell int, score double")
        return top_k(found, refine)

    def exact(best: DataFrame, asked: DataFrame) -> DataFrame:
        best = saved(best.select("qid", "doc_id", "cell", F.call_function("div", F.col("cell"), F.lit(16)).cast("int").alias("shelf")))
        shelves = [r.shelf for r in best.select("shelf").distinct().collect()]  # a sixteenth of the cells at most
        rows = index.vectors.where(F.col("shelf").isin(shelves)).select("cell", F.col("id").alias("doc_id"), F.col("embedding").alias("v"))
        q = asked.select("qid", F.col("embedding").cast("array<double>").alias("q"))
        return best.join(rows, ["cell", "doc_id"]).join(q, "qid").select("qid", "doc_id", F.round(dot(F.col("q"), F.col("v")), 12).alias("score"))

    for row in queries.select("qid", "embedding").toLocalIterator():
        held.append(row)
        if len(held) == chunk:
            part, held = search(held), []
            out = part if out is None else out.union(part)
    if held:
        out = search(held) if out is None else out.union(search(held))
    if out is None:
        return queries.select("qid").limit(0).select("qid", F.lit(None).cast(kinds[1]).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return top_k(exact(out, queries), k)
