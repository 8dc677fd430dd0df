"""Searches and reports whose work must not be the product of copies, held against plain forms."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemniscate.functions import paths
from lemniscate.operators import index, metrics, search
from lemniscate.plans import catalog

TEXTS = ["a+b", "a+c", "x_1+x_2", "a+b+a+b", "", None, r"\frac{a}{b}", "x_1+x_3"]


def rows(spark, n=240):
    return spark.createDataFrame([(i, TEXTS[i * 7 % 8]) for i in range(n)], "fid long, latex string").repartition(3)


def test_bigram_search_compares_distinct_texts(spark):
    docs = rows(spark)
    own = index.bigram_index(docs, "fid", F.col("latex"))
    assert own.classes.count() == len(TEXTS) and {r.n for r in own.classes.collect()} == {30}
    got = search.bigram_search(docs.where("fid % 20 = 0"), "fid", F.col("latex"), own, 35)
    lists = {r.id: r.paths for r in index.bigram_paths(docs, "fid", F.col("latex")).collect()}
    df = {}
    for own_paths in lists.values():
        for p in set(own_paths):
            df[p] = df.get(p, 0) + 1
    want = set()
    for q in range(0, 240, 20):
        scores = [(-round(sum(lists[q].count(p) * math.log10(240 / (df[p] + 1)) for p in set(lists[q]) & set(d)) / math.sqrt(len(d)), 9), i) for i, d in lists.items() if set(d) & set(lists[q])]
        want |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scores)[:35])}
    assert want and {(r.qid, r.doc_id, r.rank) for r in got.collect()} == want


def test_stack_search_compares_distinct_texts(spark):
    docs = rows(spark)
    own = index.stack_index(docs, "fid", F.col("latex"))
    assert own.classes.count() == len(TEXTS)
    got = search.stack_search(docs.where("fid % 20 = 0"), "fid", F.col("latex"), own, 35, min_idf=0.5)
    tf, idf = {}, {r.path: r.idf for r in own.idf.collect()}
    for r in own.postings.collect():
        tf.setdefault(r.id, {})[r.path] = r.tf
    want = set()
    for q in docs.where("fid % 20 = 0").select("fid", paths.words(F.col("latex")).alias("w")).collect():
        scores = []
        for i, own_tf in tf.items():
            shared = [p for p in q.w or [] if p in own_tf and idf[p] >= 0.5]
            if shared:
                scores.append((-round(sum(own_tf[p] / (own_tf[p] + 2) * idf[p] * (1.5 if "_" in p else 1) for p in shared), 9), i))
        want |= {(q.fid, i, rank + 1) for rank, (_, i) in enumerate(sorted(scores)[:35])}
    assert want and {(r.qid, r.doc_id, r.rank) for r in got.collect()} == want


def test_containment_of_texts(spark):
    docs = rows(spark).select(F.col("fid").alias("id"), F.col("latex").alias("text"))
    queries = docs.where("id % 20 = 0").withColumnRenamed("id", "qid")
    all_paths = index.bigram_paths(docs, "id", F.col("text")).select(F.col("id").alias("doc_id"), F.explode(F.array_distinct("paths")).alias("path"))
    want = search.containment(all_paths.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), all_paths)
    assert sorted(search.containment_of_texts(queries, docs).collect()) == sorted(want.collect())


def test_containment_makes_and_rounds_scores_before_copies(spark, tmp_path):
    """Rows of one text come from several tasks, none is rounded by itself, no copies are broadcast; null ids and single copies stay."""
    spark.range(6000).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    plan = catalog.queries()["q34_containment"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "round(" not in plan and "Broadcast" not in plan
    docs = spark.range(4000).select("id", F.lit("a+b+c").alias("text")).union(spark.createDataFrame([(4000, "b+c"), (None, "b+c"), (4001, "z")], "id long, text string"))
    queries = docs.where("id % 50 = 0").withColumnRenamed("id", "qid")
    got = search.containment_of_texts(queries, docs, 3)
    want = {(q, d, 1.0) for q in range(0, 4000, 50) for d in range(4000)} | {(q, d, 0.5) for q in range(0, 4000, 50) for d in (4000, None)} | {(4000, d, 1.0) for d in range(4001)} | {(4000, None, 1.0)}
    found = got.collect()
    assert len(found) == len(want) and set(map(tuple, found)) == want
    shares = [r["count"] for r in got.where("score = 1 and qid < 4000 and doc_id < 4000").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) < sum(shares) / 2


def test_containment_rounds_once(spark):
    docs = spark.createDataFrame([(0, "a+b+"), (1, "a+"), (2, "+b+")], "id long, text string")
    found = search.containment_of_texts(docs.where("id = 0").withColumnRenamed("id", "qid"), docs, 3).collect()
    assert {(r.doc_id, r.score) for r in found} == {(0, 1.0), (1, 0.333), (2, 0.667)}


def test_exact_lookup_cuts_buckets_before_the_join(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("h").alias("hash"))
    found = search.exact_lookup(docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid"), docs, limit=4)
    assert sorted((r.qid, r.doc_id, r.rank) for r in found.collect()) == [(q, d, d + 1) for q in range(0, 300, 10) for d in range(4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_nth" in plan[plan.index("Join"):]


def test_dual_hash_recall(spark):
    docs = spark.createDataFrame([(i, i % 3, ["", "p", "q", None][i % 4], "xyzxx"[i % 5]) for i in range(120)], "doc_id long, v long, a string, b string")
    queries = docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid")
    run = search.dual_lookup(queries.select("qid", "a", "b"), docs.select("doc_id", "a", "b"), ("a", "b")).withColumn("rank", F.lit(1))
    qrels = queries.select("qid", "v").join(docs.select("doc_id", "v"), "v").select("qid", "doc_id", F.lit(1).alias("rel"))
    want = metrics.set_family(run, qrels).select("qid", "n_truth", "hits", "recall")
    assert sorted(metrics.dual_hash_recall(queries, docs, "v", ("a", "b")).collect()) == sorted(want.collect())


def test_first_hits(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 2), (3, 9, 1)], "qid long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 6, 1), (2, 7, 1), (2, 8, 1), (3, 1, 1), (4, 4, 1)], "qid long, doc_id long, rel int")
    got = metrics.first_hits(run, qrels, qrels.select("qid").distinct())
    assert sorted(got.select("qid", "mrr", "p1").collect()) == sorted(metrics.linear_family(run, qrels).select("qid", "mrr", "p1").collect())


def test_best_of_matrices():
    rng = np.random.default_rng(3)
    scores, names = rng.integers(0, 9, size=(200, 7)) / 8, rng.permutation(200)
    scores[5, 2] = np.nan
    best = search.Best(7, 6, room=50)
    for at in range(0, 200, 11):
        best.add(scores[at : at + 11], names[at : at + 11])
    col, name, _ = best.best()
    for c in range(7):
        want = sorted(range(200), key=lambda r: (-np.inf if np.isnan(scores[r, c]) else -scores[r, c], names[r]))[:6]
        assert name[col == c].tolist() == [names[r] for r in want]


def test_score_matrices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array([[float(i), 1.0] for i in range(10_000)])], names=["embedding"])
    sizes = [len(m) for _, m in search.matrix_slices(iter([batch]), 4096)]
    assert sum(sizes) == 10_000 and max(sizes) * 4096 <= 1 << 20


def test_cosine_pairs(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 2)], i % 4 if i < 30 else None) for i in range(40)], "id long, embedding array<float>, label int")
    got = search.cosine_pairs(v.where("id % 5 = 0").withColumnRenamed("id", "qid"), v, "label", block=2).collect()
    kept = [(r.id, np.array(r.embedding), r.label) for r in v.collect()]
    want = {}
    for q, a, k in kept:
        for d, b, m in kept:
            if q % 5 == 0 and k is not None and k == m:
                size = np.linalg.norm(a) * np.linalg.norm(b)
                want[q, d] = a @ b / size if size else None
    assert len(got) == len(want) and {(r.qid, r.doc_id): r.cosine and round(r.cosine, 9) for r in got} == {k: x and pytest.approx(x) for k, x in want.items()}
