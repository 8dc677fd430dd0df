"""Ranking features, the ranker and pair scorers against plain forms."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemniscate.operators import learn, scorers


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TEXTS = {1: r"\frac{a}{b} + 12", 2: r"\frac{a}{c} + 12", 3: r"\sum_{i=1}^{n} i", 4: "", 5: None, 6: "x"}


def test_features(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, latex string")
    queries = docs.select(F.col("doc_id").alias("qid"), "latex", F.lit(1).alias("score"))  # a clashing column
    run = spark.createDataFrame([(q, d, float(d), d) for q in TEXTS for d in [*TEXTS, 99]], "qid long, doc_id long, score double, rank int")
    rows = {(r.qid, r.doc_id): r for r in learn.with_features(run, queries, docs).collect()}
    assert set(rows) == {(q, d) for q in TEXTS for d in TEXTS}  # 99 is in no table
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    for (q, d), r in rows.items():
        a, b = TEXTS[q] or "", TEXTS[d] or ""
        longer = max(len(a), len(b))
        assert r.edit == pytest.approx(1 - edit_distance(a, b) / longer if longer else 1.0)
        s, t = (re.findall(r"\\[a-zA-Z]+|[{}]|[0-9a-zA-Z]|[+\-*/=()_^]", re.sub(r"\s", "", x)) for x in (a, b))
        assert r.symbols == pytest.approx(jaccard(s, t))
        assert r.bigrams == pytest.approx(jaccard(list(zip(s, s[1:])), list(zip(t, t[1:]))))
        assert r.commands == pytest.approx(jaccard(*(re.findall(r"\\[a-zA-Z]+", x) for x in (a, b))))
        assert r.literals == pytest.approx(jaccard(*(re.findall(r"[a-zA-Z]|\d+", re.sub(r"\\[a-zA-Z]+", " ", x)) for x in (a, b))))
        assert r.length == pytest.approx(min(len(s), len(t)) / max(len(s), len(t)) if s or t else 1.0)
        assert r.score == d and r.reciprocal_rank == pytest.approx(1 / d)
    assert rows[1, 1].same_skeleton == 1 and rows[1, 2].same_skeleton == 1 and rows[1, 3].same_skeleton == 0
    assert rows[1, 1].cosine == pytest.approx(1) and rows[1, 4].cosine == 0
    assert rows[4, 5].groups == 1 and rows[1, 3].groups == 1 and rows[1, 6].groups == 0


def plain_gradient(x, y, w):
    """The same, pair by pair."""
    s = [float(np.dot(r, w)) for r in x]
    order = sorted(range(len(y)), key=lambda i: (-s[i], i))
    place = {i: k + 1 for k, i in enumerate(order)}
    ideal = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted(y, reverse=True)))
    out = np.zeros(len(w))
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j]:
                swap = abs((2 ** y[i] - 2 ** y[j]) * (1 / math.log2(place[i] + 1) - 1 / math.log2(place[j] + 1))) / ideal
                out += swap / (1 + math.exp(s[i] - s[j])) * (x[i] - x[j])
    return out


def test_gradient():
    r = np.random.default_rng(1)
    x, y, w = r.normal(size=(9, 3)), r.integers(0, 4, 9).astype(float), r.normal(size=3)
    got, ndcg = learn.swap_gradient(x, y, w)
    assert got == pytest.approx(plain_gradient(x, y, w)) and 0 < ndcg <= 1
    assert learn.swap_gradient(x, np.zeros(9), w) is None
    tied = np.zeros((4, 3))
    assert learn.swap_gradient(tied, np.array([0.0, 1, 0, 2]), w)[0] == pytest.approx(np.zeros(3))


def judged_rows(spark, n=40, per=12):
    """Labels follow a + b; neither column alone orders them."""
    r = np.random.default_rng(3)
    a, b = r.normal(size=(2, n, per))
    level = lambda t: int(np.digitize(t, [0.0, 1.0, 2.0]))
    rows = [(q, d, level(a[q, d] + b[q, d]), float(a[q, d]), float(b[q, d]), 1.0) for q in range(n) for d in range(per)]
    return spark.createDataFrame(rows, "qid long, doc_id long, label int, a double, b double, flat double"), np.stack([a, b], axis=2)


def test_ranker(spark):
    rows, _ = judged_rows(spark)
    ranker = learn.fit_ranker(rows.where("qid < 25"), ("a", "b", "flat"))
    assert ranker.weights[2] == 0 and ranker.trace[-1] > ranker.trace[0]
    held = learn.ndcg_of_scores(rows.where("qid >= 25"), {"a": F.col("a"), "b": F.col("b"), "ranker": ranker.score()})
    ndcg = {r.model: r.ndcg for r in held.collect()}
    assert ndcg["ranker"] > 0.97 > max(ndcg["a"], ndcg["b"])


def test_ranker_rounds(spark):
    """Weights after a few rounds are those of the plain form over all groups."""
    rows, x = judged_rows(spark, 6, 5)
    y = {(r.qid, r.doc_id): r.label for r in rows.collect()}
    got = learn.fit_ranker(rows, ("a", "b"), rounds=3)
    flat = x.reshape(-1, 2)
    x = (x - flat.mean(axis=0)) / flat.std(axis=0)
    w, past = np.zeros(2), np.zeros(2)
    for _ in range(3):
        groups = [(x[q], [y[q, d] for d in range(5)]) for q in range(6)]
        g = np.mean([plain_gradient(a, b, w) for a, b in groups if max(b)], axis=0)
        past += g**2
        w = w + 0.3 * g / np.sqrt(past + 1e-12)
    assert got.weights == pytest.approx(w.tolist())


def test_ranker_odd_inputs(spark):
    rows, _ = judged_rows(spark, 3, 4)
    none = learn.fit_ranker(rows.where("qid < 0"), ("a", "b"))
    assert none.weights == [0.0, 0.0] and none.trace == []
    assert learn.fit_ranker(rows.withColumn("label", F.lit(None).cast("int")), ("a",)).weights == [0.0]
    gaps = rows.withColumn("a", F.when(F.col("doc_id") > 0, F.col("a")))
    assert all(map(math.isfinite, learn.fit_ranker(gaps, ("a", "b"), rounds=2).weights))
    twice = learn.fit_ranker(rows.union(rows), ("a", "b"), rounds=2)  # repeated rows are rows of their own
    assert all(map(math.isfinite, twice.weights))
    with pytest.raises(Exception, match="cut the run first"):
        learn.fit_ranker(rows, ("a",), most=3)


def test_ndcg_of_scores(spark):
    rows = spark.createDataFrame([(1, 1, 0, 3.0), (1, 2, 2, 2.0), (1, 3, 1, None), (2, 1, 0, 1.0)], "qid long, doc_id long, label int, s double")
    got = learn.ndcg_of_scores(rows, {"s": F.col("s")}, 2).first()
    assert got.n == 1 and got.ndcg == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))


@pytest.fixture
def lengths():
    """A local function, which workers get whole: they can't import this file."""
    return lambda: lambda lefts, rights: [float("nan") if a == "nan" else len(a) / (len(a) + len(b)) for a, b in zip(lefts, rights)]


def test_pair_scores(spark, tmp_path, lengths):
    log = str(tmp_path / "asked")

    def counted():
        def score(lefts, rights):
            with open(log, "a") as f:
                f.writelines(f"{a}|{b}\n" for a, b in zip(lefts, rights))
            assert len(lefts) <= 2
            return lengths()(lefts, rights)

        return score

    rows = [("ab", "abcdef"), ("ab", "abcdef"), ("", "x"), (None, "x"), ("x", " "), ("same", "same"), ("nan", "y"), ("é", "abc"), (None, None)]
    pairs = spark.createDataFrame([(i, *r, 7) for i, r in enumerate(rows)], "id long, a string, b string, score int")
    got = {r.id: r for r in scorers.with_pair_scores(pairs, "a", "b", counted, batch=2).collect()}
    assert [got[i].prob for i in range(9)] == [0.25, 0.25, 0, 0, 0, 1, None, 0.25, 0]
    assert got[0].score == 7 and set(got[0].asDict()) == {"id", "a", "b", "score", "prob"}
    assert sorted(open(log).read().split()) == ["ab|abcdef", "nan|y", "é|abc"]  # distinct pairs, none that is blank or equal
    assert scorers.with_pair_scores(pairs.where("id < 0"), "a", "b", lengths).count() == 0
    with pytest.raises(Exception, match="gave 0 scores"):
        scorers.with_pair_scores(pairs, "a", "b", lambda: lambda a, b: []).collect()


def test_rerank_by_model(spark, lengths):
    run = spark.createDataFrame([(1, d, 1.0 / d, d) for d in (1, 2, 3, 4)], "qid long, doc_id long, score double, rank int")
    docs = spark.createDataFrame([(1, "abcd"), (2, "a"), (3, "q"), (4, "")], "doc_id long, latex string")
    queries = spark.createDataFrame([(1, "q")], "qid long, latex string")
    rows = scorers.rerank_by_model(run, queries, docs, lengths, head=3).orderBy("new_rank").collect()
    assert [r.doc_id for r in rows] == [3, 2, 1, 4]  # equal text 1, then 1/2, 1/5, and the tail
