"""Retrieval metrics.  The families differ on purpose: in their gain, in what counts as relevant, in queries without a run.

Where judgments are far more than the runs' own pairs, a family takes `counts` (qid, rel, n), the numbers of all judgments;
qrels then need only hold those of the run's own pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (0 where unjudged), is_judged, hits (relevant ones up to the rank), and above (judged others before it)."""
    rows = run.select("qid", "doc_id", "rank").join(qrels.select("qid", "doc_id", F.col("rel").alias("r")), ["qid", "doc_id"], "left")
    rows = rows.select("qid", "doc_id", "rank", F.coalesce("r", F.lit(0)).alias("rel"), F.col("r").isNotNull().alias("is_judged"))
    order = W.partitionBy("qid").orderBy("rank")
    hits = F.sum((F.col("rel") > 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.coalesce(F.sum((F.col("is_judged") & (F.col("rel") == 0)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("hits", hits).withColumn("above", above)


def judgment_counts(qrels: DataFrame) -> DataFrame:
    """(qid, rel, n): how many documents of a query are judged so."""
    return qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))


def linear_gain(rel: Column) -> Column:
    return rel.cast("double")


def exponential_gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def dcg(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)


def totals(qrels: DataFrame, k: int | str | None, gain=linear_gain, counts: DataFrame | None = None) -> DataFrame:
    """(qid, n_rel, n_non, n_judged, idcg) of each query; idcg over the first k, which may be a column of counts.

    The ideal order needs no sort of the documents: those of one relevance stand behind all of a higher one.
    """
    rows = judgment_counts(qrels) if counts is None else counts
    order = W.partitionBy("qid").orderBy(F.col("rel").desc())
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = F.col("before") + F.col("n")
    last = last if k is None else F.least(last, (F.col(k) if isinstance(k, str) else F.lit(k)).cast("long"))
    ranks = F.when(last > F.col("before"), F.sequence(F.col("before") + 1, last)).otherwise(F.array().cast("array<bigint>"))
    part = F.aggregate(ranks, F.lit(0.0), lambda s, rank: s + dcg(gain(F.col("rel")), rank))
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy("qid").agg(number(F.col("rel") > 0).alias("n_rel"), number(F.col("rel") == 0).alias("n_non"), F.sum("n").alias("n_judged"), F.coalesce(F.sum(part), F.lit(0.0)).alias("idcg"))


def precision_at(k: int) -> Column:
    return F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1.0).otherwise(0.0)) / k


def reciprocal_rank(where: Column) -> Column:
    return F.coalesce(1.0 / F.min(F.when(where, F.col("rank"))), F.lit(0.0))


def summed_precision() -> Column:
    return F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0))


def exponential_family(run: DataFrame, qrels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per query of the run that has judgments: recall (1 if any judged document came), ap, ndcg with gain 2**rel - 1, the
    ideal cut at the number of answers."""
    rows = judged(run, qrels)
    n = rows.groupBy("qid").agg(F.max(F.col("is_judged").cast("int")).cast("double").alias("recall"), summed_precision().alias("ps"), F.sum(dcg(exponential_gain(F.col("rel")), F.col("rank"))).alias("dcg"), F.max("rank").alias("depth"))
    all_ = judgment_counts(qrels) if counts is None else counts
    best = totals(qrels, "depth", exponential_gain, all_.join(n.select("qid", "depth"), "qid"))
    return n.join(best, "qid").select("qid", "recall", (F.col("ps") / F.greatest("n_rel", F.lit(1))).alias("ap"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def linear_family(run: DataFrame, qrels: DataFrame, k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Per judged query with a relevant document: p1, mrr, ndcg (first k), ap; all 0 for queries that the run lacks."""
    rows = judged(run, qrels).groupBy("qid").agg(precision_at(1).alias("p1"), reciprocal_rank(F.col("rel") > 0).alias("mrr"), F.sum(F.when(F.col("rank") <= k, dcg(linear_gain(F.col("rel")), F.col("rank"))).otherwise(0.0)).alias("dcg"), summed_precision().alias("ps"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = totals(qrels, k, counts=counts).join(rows, "qid", "left").where((F.col("n_rel") > 0) | F.col("p1").isNull())
    return both.select("qid", zero(F.col("p1")).alias("p1"), zero(F.col("mrr")).alias("mrr"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"), zero(F.when(F.col("n_rel") > 0, F.col("ps") / F.col("n_rel"))).alias("ap"))


def full_family(run: DataFrame, qrels: DataFrame, depth: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """Per query in both with a relevant document: p1, p5, p10, p20, mrr, ap, ndcg20, bpref."""
    rows = judged(run.where(F.col("rank") <= depth), qrels).join(totals(qrels, 20, counts=counts), "qid").where("n_rel > 0")
    bound = F.least("n_rel", "n_non")
    part = F.when(F.col("rel") > 0, 1 - F.col("above") / F.greatest(bound, F.lit(1))).otherwise(0.0)
    out = rows.groupBy("qid", "n_rel", "n_non", "idcg").agg(*[precision_at(k).alias(f"p{k}") for k in (1, 5, 10, 20)], reciprocal_rank(F.col("rel") > 0).alias("mrr"), summed_precision().alias("ps"), F.sum(F.when(F.col("rank") <= 20, dcg(linear_gain(F.col("rel")), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(part).alias("bp"))
    bpref = F.when(F.col("n_non") == 0, F.col("mrr")).otherwise(F.greatest(F.col("bp") / F.col("n_rel"), F.lit(0.0)))
    return out.select("qid", "p1", "p5", "p10", "p20", "mrr", (F.col("ps") / F.col("n_rel")).alias("ap"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg20"), bpref.alias("bpref"))


def judged_only(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run's judged documents, ranked anew."""
    kept = run.join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def prime_family(run: DataFrame, qrels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """p10, ap, mrr, ndcg20 of the run, and p10_prime, ap_prime, ndcg20_prime of its judged documents."""
    plain = full_family(run, qrels, counts=counts).select("qid", "p10", "ap", "mrr", "ndcg20")
    prime = full_family(judged_only(run, qrels), qrels, counts=counts).select("qid", F.col("p10").alias("p10_prime"), F.col("ap").alias("ap_prime"), F.col("ndcg20").alias("ndcg20_prime"))
    return plain.join(prime, "qid")


def set_family(run: DataFrame, qrels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per judged query: n_truth (all judged), n_retrieved, hits, recall, precision (0 without answers)."""
    rows = judged(run, qrels).groupBy("qid").agg(F.count_distinct("doc_id").alias("n_retrieved"), F.count_if("is_judged").alias("hits"))
    both = (judgment_counts(qrels) if counts is None else counts).groupBy("qid").agg(F.sum("n").alias("n_truth")).join(rows, "qid", "left").fillna(0, ["n_retrieved", "hits"])
    return both.select("qid", "n_truth", "n_retrieved", "hits", (F.col("hits") / F.col("n_truth")).alias("recall"), F.when(F.col("n_retrieved") > 0, F.col("hits") / F.col("n_retrieved")).otherwise(0.0).alias("precision"))


def any_judged_mrr(run: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """(qid, mrr): the first judged document of any relevance in the head, for each query of the run."""
    return judged(run.where(F.col("rank") <= depth), qrels).groupBy("qid").agg(reciprocal_rank(F.col("is_judged")).alias("mrr"))


def first_hits(run: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """linear_family's mrr and p1 where only the run's own relevant pairs are known: hits (qid, doc_id), and the queries
    (qid) that have a relevant document at all, so the judgments of documents that never came aren't read."""
    found = run.join(hits.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    rows = queries.select("qid").join(found, "qid", "left")
    return rows.select("qid", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("mrr"), F.when(F.col("rank") == 1, 1.0).otherwise(0.0).alias("p1"))


def dual_hash_recall(queries: DataFrame, docs: DataFrame, group: str, hashes: tuple[str, str]) -> DataFrame:
    """(qid, n_truth, hits, recall) where the documents of a query's group are its truths and those of either hash its answers:
    set_family over dual_lookup, counted by cells of group and hashes, so that neither side's pairs are made."""
    a, b = hashes
    cells = docs.groupBy(group, a, b).agg(F.count("*").alias("n"))
    rows = queries.select("qid", group, a, b).join(cells.groupBy(group).agg(F.sum("n").alias("n_truth")), group)
    for keys, name in (([group, a], "n_a"), ([group, b], "n_b"), ([group, a, b], "n_both")):
        held = cells if len(keys) == 3 else cells.groupBy(*keys).agg(F.sum("n").alias("n"))
        for h in keys[1:]:
            held = held.where(F.col(h) != "")
        rows = rows.join(held.withColumnRenamed("n", name), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    hits = (zero("n_a") + zero("n_b") - zero("n_both")).cast("long")
    return rows.select("qid", "n_truth", hits.alias("hits"), (hits / F.col("n_truth")).alias("recall"))


def half_open_histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(low, high, n) of bins [low, high) that aren't empty; the last edge itself is in no bin."""
    bins = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(edges, edges[1:])])
    own = F.filter(bins, lambda b: (F.col(column) >= b["low"]) & (F.col(column) < b["high"]))
    return rows.select(F.explode(own).alias("b")).groupBy("b.low", "b.high").agg(F.count("*").alias("n"))


def paired_t(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: n, mean_diff, t of the paired differences a - b."""
    d = a.select("qid", F.col(column).alias("x")).join(b.select("qid", F.col(column).alias("y")), "qid").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")).select("n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the regularised incomplete beta function's continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
        out = d
        for m in range(1, 300):
            for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + part * d) or 1e-300)
                c = (1 + part / c) or 1e-300
                out *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return out

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def fixed_truth_mrr(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, mrr) where only one given document counts: truth (qid, doc_id), one row a query; 0 where the run lacks it."""
    found = run.join(truth, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return truth.select("qid").join(found, "qid", "left").select("qid", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("mrr"))


def trec_family(run: DataFrame, qrels: DataFrame, digits: int = 4, counts: DataFrame | None = None) -> DataFrame:
    """recip_rank, ndcg_cut_10, map and P_1 as the TREC tool gives them: ranks anew by score, ties by the greater id as
    text, linear gain, queries in both tables, rounded."""
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("doc_id").cast("string").desc())
    rows = judged(run.select("qid", "doc_id", F.row_number().over(order).alias("rank")), qrels)
    own = rows.groupBy("qid").agg(reciprocal_rank(F.col("rel") > 0).alias("recip_rank"), F.sum(F.when(F.col("rank") <= 10, dcg(linear_gain(F.col("rel")), F.col("rank"))).otherwise(0.0)).alias("dcg"), summed_precision().alias("ps"), precision_at(1).alias("P_1"))
    both = own.join(totals(qrels, 10, counts=counts), "qid")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("qid", *[F.round(c, digits).alias(n) for n, c in (("recip_rank", F.col("recip_rank")), ("ndcg_cut_10", share("dcg", "idcg")), ("map", share("ps", "n_rel")), ("P_1", F.col("P_1")))])


def mean_std(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, n, mean, std: of the population)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def grid_report(runs: DataFrame, qrels: DataFrame, baseline: DataFrame) -> DataFrame:
    """(setting, n, mrr, mean_diff, t, is_best) of fused runs (setting, qid, doc_id, score) against a baseline run.

    mrr: of the first judged document in the first ten; is_best: the greatest mrr, the least setting on ties.
    """
    order = W.partitionBy("setting", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = runs.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    hit = ranked.join(qrels.select("qid", "doc_id", F.lit(True).alias("hit")), ["qid", "doc_id"], "left").groupBy("setting", "qid").agg(reciprocal_rank(F.col("hit")).alias("m"))
    base = any_judged_mrr(baseline, qrels).select("qid", F.col("mrr").alias("base"))
    d = hit.join(base, "qid").withColumn("d", F.col("m") - F.col("base"))
    out = d.groupBy("setting").agg(F.count("*").alias("n"), F.avg("m").alias("mrr"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    best = F.row_number().over(W.orderBy(F.round("mrr", 9).desc(), "setting")) == 1  # a row for each setting, a short list
    return out.select("setting", "n", "mrr", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"), best.alias("is_best"))


def with_p_values(report: DataFrame) -> DataFrame:
    """A report of a few rows with n and t, and the two-sided p of Student's t."""
    rows = [(*r, None if r.t is None else t_p_value(float(r.t), int(r.n) - 1)) for r in report.collect()]
    return report.sparkSession.createDataFrame(rows, report.schema.add("p", "double"))


def by_complexity(run: DataFrame, qrels: DataFrame, queries: DataFrame, edges: tuple[int, ...] = (20, 50, 999), size: str = "n_tokens") -> DataFrame:
    """(bin, n, mrr, p1) of queries (qid, size) in bins below the first edge, up to the next, and so on; larger ones are left out."""
    return in_bins(linear_family(run, qrels), queries, edges, size)


def in_bins(measures: DataFrame, queries: DataFrame, edges: tuple[int, ...], size: str = "n_tokens") -> DataFrame:
    """by_complexity of measures (qid, mrr, p1) that are there already."""
    own = measures.join(queries.select("qid", size), "qid")
    label, low = None, 0
    for high in edges:
        inside = (F.col(size) >= low) & (F.col(size) < high)
        label = F.when(inside, f"{low}-{high}") if label is None else label.when(inside, f"{low}-{high}")
        low = high
    return own.withColumn("bin", label).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("mrr").alias("mrr"), F.avg("p1").alias("p1"))
