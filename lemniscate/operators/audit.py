"""Coverage, eligibility, diversity and consistency checks, and text matching across tables."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import saved
from .search import containment, top_k


def coverage(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: labelled pairs, those whose document the corpus has, their share, queries without any."""
    there = corpus.select("doc_id").distinct().withColumn("there", F.lit(True))
    rows = qrels.join(there, "doc_id", "left")
    per = rows.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.coalesce("there", F.lit(False))).alias("found"))
    return per.agg(F.sum("n").alias("labelled"), F.sum("found").alias("in_corpus"), (F.sum("found") / F.sum("n")).alias("upper_bound"), F.count_if(F.col("found") == 0).alias("empty_queries"))


def eligibility(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(status, n): queries (qid, n_paths) that are unlabelled, without a truth in the corpus, without a path, or ok."""
    labelled = qrels.select("qid").distinct().withColumn("labelled", F.lit(True))
    found = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").select("qid").distinct().withColumn("found", F.lit(True))
    status = F.when(F.col("labelled").isNull(), "unlabelled").when(F.col("found").isNull(), "no_truth_in_corpus").when(F.col("n_paths") < 1, "no_path").otherwise("ok")
    return queries.join(labelled, "qid", "left").join(found, "qid", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def diversity(run: DataFrame, frequency: DataFrame, depth: int = 100, k: int = 10) -> DataFrame:
    """Per query: how many instances (frequency of the document, 1 if unknown) stand behind the head, and the gain at k."""
    rows = run.where(F.col("rank") <= depth).join(frequency, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    slots = F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0))
    return rows.groupBy("qid").agg((F.sum("n") / depth).alias("inflation"), slots.alias("expanded_at_k"), (k / (slots / k)).alias("gain"))


def noise_density(run: DataFrame, qrels: DataFrame, near: float = 0.94) -> DataFrame:
    """Per query: score of the first, mean of the first 10 and 100, share of the first 100 above `near` (of 100), rank of the first truth."""
    truth = qrels.where("rel > 0").select("qid", "doc_id", F.lit(True).alias("truth"))
    rows = run.join(truth, ["qid", "doc_id"], "left")
    head = lambda k, c: F.when(F.col("rank") <= k, c)
    return rows.groupBy("qid").agg(F.max(head(1, F.col("score"))).alias("top1"), F.avg(head(10, F.col("score"))).alias("top10"), F.avg(head(100, F.col("score"))).alias("top100"), (F.sum(head(100, (F.col("score") > near).cast("int"))) / 100).alias("near_share"), F.min(F.when(F.col("truth"), F.col("rank"))).alias("truth_rank"))


def best_improvement(a: DataFrame, b: DataFrame, low: int = 50, high: int = 500) -> DataFrame:
    """The (qid, doc_id) whose rank falls most from a (between low and high) to b."""
    both = a.where(F.col("rank").between(low, high)).select("qid", "doc_id", F.col("rank").alias("before")).join(b.select("qid", "doc_id", F.col("rank").alias("after")), ["qid", "doc_id"])
    return both.withColumn("gain", F.col("before") - F.col("after")).orderBy(F.col("gain").desc(), "qid", "doc_id").limit(1)


def extremes(rows: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The n best and the n worst queries of a report, ties by qid."""
    best = rows.orderBy(F.col(column).desc(), "qid").limit(n).withColumn("side", F.lit("best"))
    worst = rows.orderBy(F.col(column), "qid").limit(n).withColumn("side", F.lit("worst"))
    return best.union(worst)


def self_retrieval(run: DataFrame, least: float = 0.99) -> DataFrame:
    """One row: queries whose first answer is themselves at that score, and all queries."""
    return run.where("rank = 1").agg(F.count_if((F.col("qid") == F.col("doc_id")) & (F.col("score") > least)).alias("ok"), F.count("*").alias("n"))


def ready(report: DataFrame, least: float = 0.85) -> bool:
    """Whether a coverage report's bound is high enough to evaluate at all."""
    return (report.first().upper_bound or 0.0) >= least


def index_bytes(n: int, dims: int) -> float:
    """Size in GiB of n float vectors."""
    return n * dims * 4 / 2**30


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio: no native form, so an Arrow UDF."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)], dtype=float)

    return ratio(a, b)


def letters(texts: DataFrame) -> DataFrame:
    """(text, c, k): one row for the k-th time that a distinct text holds the letter c."""
    each = texts.select("text").where("text IS NOT NULL").distinct().select("text", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return each.groupBy("text", "c").agg(F.count("*").alias("n")).select("text", "c", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))


def fuzzy_candidates(queries: DataFrame, texts: DataFrame, least: float = 0.85) -> DataFrame:
    """(q, t): pairs of distinct texts whose letters allow a ratio above `least`, for texts of both tables (text).

    Matching blocks can't hold more of a letter than both texts do, so the ratio is at most twice the common letters, counted
    with repeats, by both lengths.  As rows (letter, k-th time) that is an overlap of sets, for which a prefix filter is
    exact: texts a ratio above r apart share more than n * r / (2 - r) letters of n, so they meet within the
    n - that + 1 rarest of each.  Those who meet are counted in full; only pairs that pass go on to be compared.
    """
    own = letters(queries.select("text").union(texts.select("text")))
    rare = letters(texts).groupBy("c", "k").agg(F.count("*").alias("df"))
    order = W.partitionBy("text").orderBy(F.coalesce("df", F.lit(0)), "c", "k")
    placed = own.join(rare, ["c", "k"], "left").withColumns({"at": F.row_number().over(order), "n": F.char_length("text")})
    prefix = saved(placed.where(F.col("at") <= F.col("n") - F.floor(F.col("n") * (least / (2 - least)) - 1e-9) + 1).select("text", "c", "k", "n"))
    q = prefix.join(queries.select("text").distinct(), "text", "left_semi").select(F.col("text").alias("q"), "c", "k", F.col("n").alias("n_q"))
    t = prefix.join(texts.select("text").distinct(), "text", "left_semi").select(F.col("text").alias("t"), "c", "k", F.col("n").alias("n_t"))
    met = q.join(t, ["c", "k"]).where(2 * F.least("n_q", "n_t") > least * (F.col("n_q") + F.col("n_t")) - 1e-9).select("q", "t").distinct()
    sets = saved(own.groupBy("text").agg(F.collect_list(F.concat("c", F.col("k").cast("string"))).alias("own")))
    both = met.join(sets.select(F.col("text").alias("q"), F.col("own").alias("x")), "q").join(sets.select(F.col("text").alias("t"), F.col("own").alias("y")), "t")
    near = both.where(2 * F.size(F.array_intersect("x", "y")) > least * (F.size("x") + F.size("y")) - 1e-9).select("q", "t")
    empty = queries.where("text = ''").select(F.col("text").alias("q")).distinct().join(texts.where("text = ''").select(F.col("text").alias("t")).distinct(), F.col("q") == F.col("t"))
    return near.union(empty)


def with_holders(texts: DataFrame) -> DataFrame:
    """(text, low, high: the least and the greatest id of the rows that hold it) of each text; without an id column both are null."""
    key = F.col("id") if "id" in texts.columns else F.lit(None)
    return texts.select("text", key.alias("id")).groupBy("text").agg(F.min("id").alias("low"), F.max("id").alias("high"))


def only_own() -> Column:
    """A text that no row but the query's own holds."""
    return F.coalesce((F.col("low") == F.col("qid")) & (F.col("high") == F.col("qid")), F.lit(False))


def fuzzy_best(queries: DataFrame, texts: DataFrame, least: float = 0.85) -> DataFrame:
    """(qid, text, score): the most similar text above `least`, the least text on ties.

    Where texts have an id, the query's own row is no match, but other rows of the same text are.  Only the pairs of
    fuzzy_candidates are compared, which loses none.
    """
    t = with_holders(texts).withColumnRenamed("text", "t")
    pairs = saved(fuzzy_candidates(queries, texts, least))
    scored = pairs.select("q", "t", similarity(F.col("q"), F.col("t")).alias("score")).where(F.col("score") > least)
    found = queries.select("qid", F.col("text").alias("q")).join(scored, "q").join(t, "t").where(~only_own())
    return top_k(found.select("qid", F.col("t").alias("doc_id"), "score"), 1).select("qid", F.col("doc_id").alias("text"), "score")


def first_match(queries: DataFrame, corpus: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """queries with the value of the corpus's first row of an equal key but their own, null where there is none.

    `order` is the id in both tables: of each key the first two rows are enough.
    """
    at = F.row_number().over(W.partitionBy(key).orderBy(order))
    two = corpus.withColumn("_at", at).where("_at <= 2").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_two"))
    other = F.get(F.filter("_two", lambda x: x["o"] != F.col(order)), F.lit(0))
    return queries.join(two, key, "left").withColumn(value, other["v"]).drop("_two")


def match_waterfall(queries: DataFrame, texts: DataFrame, tokens, least: float = 0.85, votes: float = 0.5) -> DataFrame:
    """(qid, text, score, strategy): equal text, else a similar one, else one sharing more than `votes` of the tokens, else none.

    tokens(column) gives a text's distinct tokens.  Where texts have an id, the query's own row is no match.
    """
    t = with_holders(texts)
    exact = saved(queries.join(t, "text").where(~only_own()).select("qid", "text", F.lit(1.0).alias("score"), F.lit("exact").alias("strategy")))
    rest = queries.join(exact.select("qid"), "qid", "left_anti")
    fuzzy = saved(fuzzy_best(rest, texts, least).withColumn("strategy", F.lit("fuzzy")))
    rest = rest.join(fuzzy.select("qid"), "qid", "left_anti")
    own = rest.select("qid", F.explode(tokens(F.col("text"))).alias("path"))
    hits = containment(own, t.select(F.col("text").alias("doc_id"), F.explode(tokens(F.col("text"))).alias("path")))
    # A query that comes this far has its text to itself, so its own row is the one of an equal text.
    hits = hits.join(rest.select("qid", "text"), "qid").where(F.col("doc_id") != F.col("text")).drop("text")
    voted = top_k(hits.where(F.col("score") > votes), 1).select("qid", F.col("doc_id").alias("text"), (F.col("score") * 0.7).alias("score"), F.lit("tokens").alias("strategy"))
    none = rest.join(voted.select("qid"), "qid", "left_anti").select("qid", F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("score"), F.lit("none").alias("strategy"))
    return exact.union(fuzzy).union(voted).union(none)


def ids_are_numbers(rows: DataFrame, column: str) -> DataFrame:
    """One row: do all ids consist of digits?"""
    return rows.agg(F.coalesce(F.bool_and(F.col(column).cast("string").rlike(r"^[0-9]+$")), F.lit(True)).alias("all_numeric"))


def alignment(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: share of the queries that are judged, of the judged documents that the corpus has, of the corpus with a
    skeleton, whether all corpus ids are numbers.  queries: qid; corpus: doc_id, skel."""
    judged = qrels.select("qid").distinct().withColumn("_j", F.lit(1))
    there = corpus.select("doc_id").distinct().withColumn("_t", F.lit(1))
    a = queries.select("qid").distinct().join(judged, "qid", "left").agg(F.avg(F.coalesce("_j", F.lit(0))).alias("query_overlap"))
    b = qrels.select("doc_id").distinct().join(there, "doc_id", "left").agg(F.avg(F.coalesce("_t", F.lit(0))).alias("corpus_coverage"))
    c = corpus.agg(F.avg((F.coalesce("skel", F.lit("")) != "").cast("int")).alias("skel_coverage"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(ids_are_numbers(corpus, "doc_id")))


def quality_counts(rows: DataFrame) -> DataFrame:
    """One row: n, with_latex, with_mathml, both, multi (queries of several formulas), real and pseudo sources.

    rows: (qid, latex, mathml, mathml_source), one for each formula of a query.
    """
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    per = rows.groupBy("qid").agg(F.max(full("latex")).alias("l"), F.max(full("mathml")).alias("m"), F.count("*").alias("k"), F.max(F.col("mathml_source") != "pseudo_mathml").alias("r"))
    return per.agg(F.count("*").alias("n"), F.count_if("l").alias("with_latex"), F.count_if("m").alias("with_mathml"), F.count_if(F.col("l") & F.col("m")).alias("both"), F.count_if(F.col("k") > 1).alias("multi"), F.count_if("r").alias("real"), F.count_if(~F.col("r")).alias("pseudo"))


def noise_summary(run: DataFrame, qrels: DataFrame, near: float = 0.94) -> DataFrame:
    """One row over noise_density: mean of its columns, mean first-truth rank and score, and the query whose first truth comes last."""
    truth = run.join(qrels.where("rel > 0").select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    first = truth.groupBy("qid").agg(F.min(F.struct("rank", "score")).alias("t")).select(F.col("qid").alias("_q"), "t.rank", "t.score")
    both = noise_density(run, qrels, near).join(first, F.col("qid") == F.col("_q"), "left")
    worst = F.max_by(F.struct(F.col("qid"), F.col("rank")), F.struct(F.col("rank"), -F.col("qid")))
    return both.agg(F.avg("top1").alias("top1"), F.avg("top10").alias("top10"), F.avg("top100").alias("top100"), F.avg("near_share").alias("near_share"), F.avg("rank").alias("truth_rank"), F.avg("score").alias("truth_score"), worst.alias("w")).select("top1", "top10", "top100", "near_share", "truth_rank", "truth_score", F.col("w.qid").alias("worst_qid"), F.col("w.rank").alias("worst_rank"))


def zero_recall(run: DataFrame, qrels: DataFrame, corpus: DataFrame, show: int = 3) -> DataFrame:
    """(qid, n_truth, doc_id, text): queries none of whose truths the run has, with their first truths that the corpus holds."""
    hit = run.join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").select("qid").distinct()
    lost = qrels.join(hit, "qid", "left_anti")
    n = lost.groupBy("qid").agg(F.count("*").alias("n_truth"))
    held = lost.select("qid", "doc_id").join(corpus.select("doc_id", "text"), "doc_id").withColumn("_at", F.row_number().over(W.partitionBy("qid").orderBy("doc_id"))).where(F.col("_at") <= show)
    return n.join(held.drop("_at"), "qid", "left").select("qid", "n_truth", "doc_id", "text")


def missed_truths(run: DataFrame, qrels: DataFrame, similarity_of: DataFrame) -> DataFrame:
    """(qid, doc_id, score): truths that the run doesn't have, with their similarity (qid, doc_id, score) to the query."""
    return qrels.select("qid", "doc_id").join(run.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(similarity_of, ["qid", "doc_id"], "left").select("qid", "doc_id", "score")


def missed_pairs(run: DataFrame, truths: DataFrame) -> DataFrame:
    """missed_truths of truths (qid, doc_id, score) that come with their similarity: they are joined with the run only."""
    return truths.join(run.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "score")


def two_stage_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row from two (qid, mrr) tables: initial, reranked, absolute gain, relative gain in percent (0 if initial is 0)."""
    both = before.select("qid", F.col("mrr").alias("a")).join(after.select("qid", F.col("mrr").alias("b")), "qid").agg(F.avg("a").alias("initial"), F.avg("b").alias("reranked"))
    gain = F.col("reranked") - F.col("initial")
    return both.select("initial", "reranked", gain.alias("gain"), F.when(F.col("initial") > 0, 100 * gain / F.col("initial")).otherwise(0.0).alias("gain_pct"))


def rehash_check(index_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: documents (doc_id, hash) of the corpus, those in the index, and those whose hash there is the same."""
    there = index_rows.select("doc_id", F.col("hash").alias("held"))
    return rows.join(there, "doc_id", "left").agg(F.count("*").alias("n"), F.count("held").alias("indexed"), F.count_if(F.coalesce(F.col("held") == F.col("hash"), F.lit(False))).alias("same_hash"))


def shape(rows: DataFrame, name: str) -> DataFrame:
    """One row: name, rows, queries, documents, and the least and most rows of a query."""
    per = rows.groupBy("qid").agg(F.count("*").alias("k"))
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("qid").alias("queries"), F.count_distinct("doc_id").alias("documents")).join(F.broadcast(per.agg(F.min("k").alias("least"), F.max("k").alias("most"))))
