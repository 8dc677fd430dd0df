"""Learning to rank: feature columns of query and candidate, and a linear ranker fitted on pairs weighted by their swap in nDCG."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import saved
from .metrics import dcg, exponential_gain
from .ranking import hashed_encoder
from .search import dot

COMMAND, LITERAL = r"\\[a-zA-Z]+", r"[a-zA-Z]|[0-9]+"
FEATURES = ("score", "reciprocal_rank", "cosine", "edit", "symbols", "bigrams", "length", "groups", "commands", "literals", "same_skeleton", "skeleton_edit")


def parts(text: Column) -> dict[str, Column]:
    """What the features compare of one formula."""
    text = F.coalesce(text, F.lit(""))
    tokens = paths.symbols(text)
    return {
        "text": text,
        "embedding": hashed_encoder()(text),
        "symbols": tokens,
        "bigrams": paths.ngrams(tokens),
        "commands": F.regexp_extract_all(text, F.lit(COMMAND), F.lit(0)),
        "literals": F.regexp_extract_all(F.regexp_replace(text, COMMAND, " "), F.lit(LITERAL), F.lit(0)),
        "skeleton": paths.skeleton(text),
    }


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays' distinct elements, 1 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance by the longer text's length, 1 where both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def nearness(a: Column, b: Column) -> Column:
    """Smaller by larger count, 1 where both are 0."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def with_features(run: DataFrame, queries: DataFrame, docs: DataFrame, text: str = "latex") -> DataFrame:
    """(qid, doc_id, rank, FEATURES) of a run's rows (qid, doc_id, score, rank); queries: (qid, text), docs: (doc_id, text).

    Candidates whose query or document is missing have no row, null texts are empty ones.  Documents are joined by id before
    anything of their text is computed, so only candidates cost more than a look at their id.
    """
    q = queries.select("qid", F.struct(*[c.alias(k) for k, c in parts(F.col(text)).items()]).alias("q"))
    d = run.select("qid", "doc_id", "score", "rank").join(docs.select("doc_id", F.col(text).alias("own_text")), "doc_id")
    d = d.select("qid", "doc_id", "score", "rank", F.struct(*[c.alias(k) for k, c in parts(F.col("own_text")).items()]).alias("d"))
    both = lambda compare, part: compare(F.col(f"q.{part}"), F.col(f"d.{part}"))
    braces = lambda side: F.size(F.filter(F.col(f"{side}.symbols"), lambda t: t == "{"))
    return d.join(q, "qid").select(
        "qid",
        "doc_id",
        "rank",
        F.col("score").cast("double").alias("score"),
        (1 / F.col("rank")).alias("reciprocal_rank"),
        both(dot, "embedding").alias("cosine"),
        both(likeness, "text").alias("edit"),
        both(overlap, "symbols").alias("symbols"),
        both(overlap, "bigrams").alias("bigrams"),
        nearness(F.size("q.symbols"), F.size("d.symbols")).alias("length"),
        nearness(braces("q"), braces("d")).alias("groups"),
        both(overlap, "commands").alias("commands"),
        both(overlap, "literals").alias("literals"),
        (F.col("q.skeleton") == F.col("d.skeleton")).cast("double").alias("same_skeleton"),
        both(likeness, "skeleton").alias("skeleton_edit"),
    )


@dataclass
class Ranker:
    """A linear score over scaled features; trace has the training groups' mean nDCG before each round."""

    features: tuple[str, ...]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    trace: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """A Column of the features; a null feature counts as its mean."""
        return sum((F.lit(w / s) * (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) for c, m, s, w in zip(self.features, self.mean, self.scale, self.weights)), F.lit(0.0))


def swap_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The direction in which w should go for one query's rows, and their nDCG; None without a relevant row.

    Each two rows of different labels push by the logistic loss's slope times what swapping their places changes in nDCG.
    """
    gain = np.exp2(y) - 1
    s = x @ w
    place = np.empty(len(y), np.int64)
    place[np.argsort(-s, kind="stable")] = np.arange(len(y))
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(y)) + 2)).sum()
    if ideal == 0:
        return None
    discount = 1 / np.log2(place + 2)
    swap = np.abs(gain[:, None] - gain) * np.abs(discount[:, None] - discount) / ideal
    push = np.where(y[:, None] > y, swap / (1 + np.exp(np.clip(s[:, None] - s, -50, 50))), 0.0)
    return (push.sum(axis=1) - push.sum(axis=0)) @ x, float((gain * discount).sum() / ideal)


def fit_ranker(rows: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 30, rate: float = 0.3, most: int = 1000) -> Ranker:
    """A ranker fitted on rows (qid, doc_id, label, features), label 0 and up; null labels are 0.

    A query's rows are one group, at most `most` of them: a run is cut at its depth before, and more rows are an error, not a
    cut.  Groups are written once, as numbers.  A round is one job in which each task sums its groups' gradients to one row a
    feature; Spark adds those up, so the driver sees as many numbers as there are features.  Weights grow by Adagrad steps.
    Features that don't vary keep the weight 0; without a group that has a relevant row all do.
    """
    d = len(features)
    value = lambda c: F.col(c).cast("double")
    found = rows.agg(*[F.avg(value(c)) for c in features], *[F.stddev_pop(value(c)) for c in features]).first()
    mean = [m or 0.0 for m in found[:d]]
    scale = [s if s and s > 1e-12 else 1.0 for s in found[d:]]
    scaled = [((F.coalesce(value(c), F.lit(m)) - m) / s) for c, m, s in zip(features, mean, scale)]
    own = F.struct("doc_id", F.coalesce("label", F.lit(0)).cast("double").alias("y"), F.array(*scaled).alias("x"))
    groups = rows.groupBy("qid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(own)).alias("g"))
    small = F.when(F.col("n") <= most, F.col("g")).otherwise(F.raise_error(F.lit(f"a query has more than {most} candidates: cut the run first")))
    groups = groups.withColumn("g", small).select(F.transform("g", lambda r: r["y"]).alias("y"), F.flatten(F.transform("g", lambda r: r["x"])).alias("x"))
    groups = saved(groups, "groups")
    weights, past, trace = np.zeros(d), np.zeros(d), []

    def slope(w: np.ndarray) -> DataFrame:
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(d + 2)
            for batch in batches:
                for y, x in zip(batch.column("y"), batch.column("x")):
                    y, x = y.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)
                    if one := swap_gradient(x.reshape(-1, d), y, w):
                        sums += [*one[0], one[1], 1]
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int32()), pa.array(sums)], names=["k", "v"])

        return groups.mapInArrow(total, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))

    for _ in range(rounds):
        sums = np.zeros(d + 2)
        for k, v in slope(weights).collect():  # one row a feature
            sums[k] = v
        if not sums[-1]:
            break
        gradient = sums[:d] / sums[-1]
        trace.append(sums[d] / sums[-1])
        past += gradient**2
        weights = weights + rate * gradient / np.sqrt(past + 1e-12)
    return Ranker(tuple(features), mean, scale, weights.tolist(), trace)


def ndcg_of_scores(rows: DataFrame, scores: dict[str, Column], k: int = 10) -> DataFrame:
    """(model, n: queries with a relevant row, ndcg: their mean nDCG of the first k) of several scores over the same rows (qid,
    doc_id, label); ties by score to nine digits go by doc_id, the ideal order is that of the same rows."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(c, 9).alias("own")) for m, c in scores.items()]))
    each = rows.select("qid", "doc_id", "label", named.alias("s")).select("qid", "doc_id", "label", "s.*")
    by = W.partitionBy("model", "qid")
    each = each.withColumn("at", F.row_number().over(by.orderBy(F.col("own").desc_nulls_last(), "doc_id"))).withColumn("best", F.row_number().over(by.orderBy(F.col("label").desc(), "doc_id")))
    part = lambda place: F.sum(F.when(F.col(place) <= k, dcg(exponential_gain(F.col("label")), F.col(place))).otherwise(0.0))
    queries = each.groupBy("model", "qid").agg(part("at").alias("own"), part("best").alias("ideal")).where("ideal > 0")
    return queries.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("own") / F.col("ideal")).alias("ndcg"))
