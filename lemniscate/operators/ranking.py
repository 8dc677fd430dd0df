"""Fusion, reranking and filtering of runs: (qid, doc_id, score, rank) rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import top_k, unit


def rrf(runs: list[tuple[DataFrame, float]], k: int = 60, limit: int | None = 100, depth: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (k + rank); `depth` cuts each run first."""
    parts = [(r if depth is None else r.where(F.col("rank") <= depth)).select("qid", "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in runs]
    fused = reduce(DataFrame.union, parts).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))
    return fused if limit is None else top_k(fused, limit)


def rrf_grid(first: DataFrame, second: DataFrame, weights: DataFrame, k: Column | int = 60, depth: int = 1000) -> DataFrame:
    """(setting columns of weights, qid, doc_id, score) for every row of weights (w, perhaps k), a short list of settings."""
    own = [c for c in weights.columns]
    both = first.where(F.col("rank") <= depth).select("qid", "doc_id", "rank", F.lit(False).alias("second")).union(second.where(F.col("rank") <= depth).select("qid", "doc_id", "rank", F.lit(True).alias("second")))
    settings = weights.select(F.collect_list(F.struct(*own)).alias("settings"))
    rows = both.join(F.broadcast(settings)).select("qid", "doc_id", "rank", "second", F.explode("settings").alias("s")).select("qid", "doc_id", "rank", "second", "s.*")
    part = F.when(F.col("second"), F.col("w") if "w" in own else F.lit(1.0)).otherwise(1.0) / ((F.col("k") if "k" in own else F.lit(k) if isinstance(k, int) else k) + F.col("rank"))
    return rows.groupBy(*own, "qid", "doc_id").agg(F.sum(part).alias("score"))


def linear(first: DataFrame, second: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * first + (1 - alpha) * second; a missing score is 0."""
    a, b = first.select("qid", "doc_id", F.col("score").alias("a")), second.select("qid", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["qid", "doc_id"], "full_outer").select("qid", "doc_id", (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))
    return top_k(both, k)


def priority_concat(runs: list[DataFrame], k: int) -> DataFrame:
    """Runs one behind the other; the first occurrence of a document stays."""
    parts = [r.select("qid", "doc_id", F.struct(F.lit(i).alias("source"), F.col("rank").cast("int").alias("pos")).alias("at")) for i, r in enumerate(runs)]
    first = reduce(DataFrame.union, parts).groupBy("qid", "doc_id").agg(F.min("at").alias("at"))
    order = W.partitionBy("qid").orderBy("at", "doc_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", F.col("at.source").alias("source"), "rank")


def waterfall(runs: list[DataFrame], everything: DataFrame, queries: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """priority_concat of runs; queries that none of them answers get k documents by MD5 of seed and id, the same for each."""
    found = priority_concat(runs, k)
    sample = everything.select("doc_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), "doc_id").limit(k)
    sample = sample.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    rest = queries.select("qid").join(found.select("qid").distinct(), "qid", "left_anti").join(F.broadcast(sample)).select("qid", F.posexplode("ids").alias("pos", "doc_id"))
    return found.union(rest.select("qid", "doc_id", F.lit(len(runs)).alias("source"), (F.col("pos") + 1).alias("rank")))


def rerank_head(run: DataFrame, scores: DataFrame, head: int = 100) -> DataFrame:
    """The first `head` by new_score of scores (qid, doc_id, new_score), the rest behind them in the old order."""
    rows = run.join(scores.select("qid", "doc_id", "new_score"), ["qid", "doc_id"], "left")
    in_head = F.when(F.col("rank") <= head, 0).otherwise(1)
    order = W.partitionBy("qid").orderBy(in_head, F.when(in_head == 0, F.round("new_score", 9)).desc_nulls_last(), F.col("rank"))
    return rows.withColumn("new_rank", F.row_number().over(order)).select("qid", "doc_id", F.col("rank").alias("old_rank"), "new_rank")


def adaptive_filter(rows: DataFrame, relax: float = 0.1, least_share: float = 0.05, many: int = 10) -> DataFrame:
    """Rows (qid, doc_id, score, threshold) that reach their threshold; a query of more than `many` candidates of which less
    than least_share pass is judged again with the threshold lowered by relax."""
    own = W.partitionBy("qid")
    passed = rows.withColumn("share", F.avg((F.col("score") >= F.col("threshold")).cast("double")).over(own)).withColumn("n", F.count("*").over(own))
    limit = F.when((F.col("share") < least_share) & (F.col("n") > many), F.col("threshold") - relax).otherwise(F.col("threshold"))
    return passed.withColumn("used", limit).where(F.col("score") >= F.col("used")).select("qid", "doc_id", "score", F.col("used").alias("threshold"))


def filter_or_all(rows: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass; all rows of a query of which none passes."""
    return rows.withColumn("_pass", passes).withColumn("_any", F.max("_pass").over(W.partitionBy("qid"))).where(F.col("_pass") | ~F.col("_any")).drop("_pass", "_any")


def prior_rerank(run: DataFrame, prior: DataFrame, alpha: float, k: int) -> DataFrame:
    """score + alpha * the document's prior, scaled to 0 .. 1 within the query (our own definition)."""
    own = W.partitionBy("qid")
    rows = run.join(prior, "doc_id", "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))
    low, high = F.min("pr").over(own), F.max("pr").over(own)
    scaled = F.when(high > low, (F.col("pr") - low) / (high - low)).otherwise(0.0)
    return top_k(rows.select("qid", "doc_id", (F.col("score") + alpha * scaled).alias("score")), k)


def hard_negatives(run: DataFrame, qrels: DataFrame, corpus: DataFrame, per_query: int = 5, depth: int = 50) -> DataFrame:
    """The first unjudged documents of each query's head that the corpus has."""
    head = run.where(F.col("rank") <= depth).join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(corpus.select("doc_id"), "doc_id", "left_semi")
    at = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    return head.withColumn("pick", at).where(F.col("pick") <= per_query).select("qid", "doc_id", "pick")


def training_pairs(run: DataFrame, qrels: DataFrame, corpus: DataFrame, per_query: int = 5, depth: int = 50, own: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, label): every judged document in the corpus is 1, hard negatives are 0.

    own: the judgments of the run's own pairs; with them, qrels are taken to be of the corpus's documents and not joined at all.
    """
    good = qrels if own is not None else qrels.join(corpus.select("doc_id"), "doc_id", "left_semi")
    negatives = hard_negatives(run, qrels if own is None else own, corpus, per_query, depth)
    return good.select("qid", "doc_id", F.lit(1).alias("label")).union(negatives.select("qid", "doc_id", F.lit(0).alias("label")))


def rrf_of_first(first: DataFrame, second: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion for the first run's queries; one that the second run lacks is an error."""
    own = first.select("qid").distinct()
    if lost := own.join(second.select("qid").distinct(), "qid", "left_anti").limit(1).collect():
        raise ValueError(f"the second run has no query {lost[0].qid}")
    return rrf([(first, 1.0), (second.join(own, "qid", "left_semi"), 1.0)], k, limit)


def rrf_of_second(first: DataFrame, second: DataFrame, w: float = 1.0, k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion for the second run's queries, the second run weighted w."""
    return rrf([(first.join(second.select("qid").distinct(), "qid", "left_semi"), 1.0), (second, w)], k, limit)


def non_blank(rows: DataFrame, column: str) -> DataFrame:
    """Candidates that have a text at all."""
    return rows.where(F.trim(F.coalesce(column, F.lit(""))) != "")


def reach_threshold(rows: DataFrame, threshold: float, on: bool = True, prob: str = "prob") -> DataFrame:
    """Candidates of that probability and more; all of them where the filter is off."""
    return rows.where(F.col(prob) >= threshold) if on else rows


def four_stages(recall: DataFrame, coarse: DataFrame, probs: DataFrame, prior: DataFrame, settings) -> DataFrame:
    """Recall, coarse rank, filter, graph prior: (qid, doc_id, score, rank).

    recall, coarse: runs; probs: (qid, doc_id, prob), a missing one is 0; prior: (doc_id, pr).  A query of which the filter
    leaves nothing keeps its coarse result.  Stages that the settings switch off pass their input on.
    """
    run = recall.where(F.col("rank") <= settings.recall).select("qid", "doc_id", "score")
    if settings.coarse:
        run = run.select("qid", "doc_id").join(coarse.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    run = top_k(run, settings.keep)
    if settings.filter:
        rows = run.join(probs, ["qid", "doc_id"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
        run = filter_or_all(rows, F.col("prob") >= settings.threshold).select("qid", "doc_id", "score", "rank")
    if settings.graph:
        return prior_rerank(run, prior, settings.alpha, settings.final)
    return top_k(run.select("qid", "doc_id", "score"), settings.final)


def with_labels(pairs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, doc_id) pairs with the judged relevance, 0 where there is none."""
    own = qrels.select("qid", "doc_id", F.col("rel").alias("label"))
    return pairs.join(own, ["qid", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def hashed_encoder(digits: int = 1) -> Callable[[Column], Column]:
    """A text's encoder without a model: counts of its words by the first digits of their MD5, scaled to length 1."""
    size = 16**digits

    def encode(text: Column) -> Column:
        words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda w: F.conv(F.substring(F.md5(w), 1, digits), 16, 10).cast("int"))
        counts = F.aggregate(words, F.array_repeat(F.lit(0.0), size), lambda s, i: F.transform(s, lambda x, k: F.when(k == i, x + 1).otherwise(x)))
        return unit(counts)

    return encode


def with_embeddings(rows: DataFrame, text: str, encoder=None, name: str = "embedding") -> DataFrame:
    """rows with the encoder's vector of a text column; any Column -> Column function will do, such as a model's pandas UDF."""
    return rows.withColumn(name, (encoder or hashed_encoder())(F.col(text)))
