"""Reports over judgments that are all pairs of a label: counted, not made, and the same as over the pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lemniscate.operators import audit, metrics, ranking, search
from lemniscate.plans import catalog, reports  # noqa: F401  (the reports register themselves)
from lemniscate.plans import views as v

FAMILIES = [metrics.exponential_family, metrics.linear_family, metrics.full_family, metrics.prime_family, metrics.set_family, metrics.trec_family]
COUNTED = ["q21_metrics_exponential", "q22_metrics_linear", "q23_metrics_full_bpref", "q24_metrics_prime", "q25_recall_histogram", "q44_any_judged_mrr", "q46_noise_density", "q71_label_attach", "q73_fixed_truth_mrr", "q74_trec_measures", "q75_noise_summary"]


@pytest.fixture(scope="module")
def vectors_dir(tmp_path_factory):
    rng = np.random.default_rng(5)
    at = tmp_path_factory.mktemp("vectors")
    label = pa.array([None if i % 97 == 3 else i % 2 for i in range(900)], pa.int32())
    vectors = pa.array([list(x) for x in rng.standard_normal((900, 8)).astype(np.float32)], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(900), pa.int64()), "embedding": vectors, "label": label}), at / "embeddings.parquet")
    return str(at)


def near(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.collect())


@pytest.mark.parametrize("family", FAMILIES, ids=lambda f: f.__name__)
def test_counts_do_for_all_judgments(spark, vectors_dir, family):
    run = v.vector_run(spark, vectors_dir).where("qid <> 300 and rank <= 20 + qid % 7")
    qrels = v.vector_qrels(spark, vectors_dir, run)
    pairs, counts = v.vector_judgments(spark, vectors_dir, run)
    assert near(metrics.judgment_counts(qrels)) == near(counts)
    got, want = family(run, pairs, counts=counts), family(run, qrels)
    assert near(got) == near(want) and want.count() > 0


def test_ideal_gain_is_that_of_sorted_judgments(spark):
    rows = [(q, i, (i * i + q) % 4) for q in range(4) for i in range(5 * q + 1)]
    qrels = spark.createDataFrame(rows, "qid long, doc_id long, rel int")
    for k in (3, 10, None):
        for gain, plain in ((metrics.linear_gain, float), (metrics.exponential_gain, lambda x: 2.0**x - 1)):
            want = {q: sum(plain(rel) / np.log2(at + 2) for at, rel in enumerate(sorted((r for p, _, r in rows if p == q), reverse=True)[:k])) for q in range(4)}
            assert {r.qid: r.idcg for r in metrics.totals(qrels, k, gain).collect()} == {q: pytest.approx(x) for q, x in want.items()}


def rows_made(df) -> int:
    """The most rows that an operator of df's executed plan made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("name", COUNTED)
def test_no_step_makes_all_pairs_of_a_label(spark, vectors_dir, name):
    # 9 queries and 900 vectors: some 4,000 pairs of a label, a run of 450 rows
    assert 0 < rows_made(catalog.queries()[name](spark, vectors_dir)) <= 900


def test_missed_pairs_and_training_pairs(spark, vectors_dir):
    run = v.vector_run(spark, vectors_dir)
    qrels = v.vector_qrels(spark, vectors_dir, run)
    q, own = v.vector_queries(spark, vectors_dir), v.vectors(spark, vectors_dir)
    truths = search.product_pairs(q, own, "label", block=2)
    scores = q.select("qid", F.col("embedding").alias("q")).join(own.select(F.col("id").alias("doc_id"), "embedding")).select("qid", "doc_id", search.dot(F.col("q"), F.col("embedding")).alias("score"))
    assert near(audit.missed_pairs(run, truths)) == near(audit.missed_truths(run, qrels.where("rel > 0"), scores))
    ids = own.select(F.col("id").alias("doc_id"))
    given = ranking.training_pairs(run, qrels, ids, own=v.run_judgments(spark, vectors_dir, run))
    assert near(given) == near(ranking.training_pairs(run, qrels, ids))


def test_vectors_of_one_row_group_are_dealt_out(spark, vectors_dir):
    own = search.dealt_out(v.vectors(spark, vectors_dir))
    sizes = own.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in sizes) == 900


def test_best_rounds_only_what_may_come_in():
    rng = np.random.default_rng(9)
    scores = np.round(rng.standard_normal((5000, 3)), 2) + rng.integers(-3, 4, (5000, 3)) * 1e-10  # ties to nine digits
    best = search.Best(3, 20, room=64)
    for at in range(0, 5000, 40):
        best.add(scores[at : at + 40], np.arange(at, at + 40))
    col, name, _ = best.best()
    for c in range(3):
        assert name[col == c].tolist() == sorted(range(5000), key=lambda r: (-np.round(np.round(scores[r, c], 12), 9), r))[:20]
