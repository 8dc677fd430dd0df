"""Scores of text pairs by a model of the user's: loaded once a task's worker, asked in batches, for distinct pairs only."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rerank_head

Scorer = Callable[[list[str], list[str]], Sequence[float]]


def with_pair_scores(pairs: DataFrame, left: str, right: str, load: Callable[[], Scorer], name: str = "prob", batch: int = 64) -> DataFrame:
    """pairs with the score of their two texts: 0 where one is null or blank, 1 where they are equal, else the model's.

    load() is called in the task, at its first pair, and returns (lefts, rights) -> scores; models thus are never pickled.
    A score that is no number is null.  Repeated pairs are asked once.  Pairs that need no model never reach Python.
    """
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    blank, same = (F.trim(a) == "") | (F.trim(b) == ""), a == b
    open_ = pairs.where(~blank & ~same).select(a.alias("_left"), b.alias("_right")).distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            lefts, rights = rows.column("_left").to_pylist(), rows.column("_right").to_pylist()
            model = model or load()
            scores: list[float] = []
            for i in range(0, len(lefts), batch):
                got = [float(s) for s in model(lefts[i : i + batch], rights[i : i + batch])]
                if len(got) != len(lefts[i : i + batch]):
                    raise ValueError(f"the model gave {len(got)} scores for {len(lefts[i : i + batch])} pairs")
                scores += got
            yield pa.RecordBatch.from_arrays([rows.column("_left"), rows.column("_right"), pa.array(scores, pa.float64(), from_pandas=True)], names=["_left", "_right", "_score"])

    scored = open_.mapInArrow(ask, "_left string, _right string, _score double")
    rows = pairs.join(scored, (a == F.col("_left")) & (b == F.col("_right")), "left")
    return rows.select(*[pairs[c] for c in pairs.columns], F.when(blank, 0.0).when(same, 1.0).otherwise(F.col("_score")).alias(name))


def rerank_by_model(run: DataFrame, queries: DataFrame, docs: DataFrame, load: Callable[[], Scorer], head: int = 100, text: str = "latex", batch: int = 64) -> DataFrame:
    """rerank_head with the model's scores of query and document; only the head's pairs are scored."""
    pairs = run.where(F.col("rank") <= head).select("qid", "doc_id").join(queries.select("qid", F.col(text).alias("_q")), "qid").join(docs.select("doc_id", F.col(text).alias("_d")), "doc_id")
    return rerank_head(run, with_pair_scores(pairs, "_q", "_d", load, "new_score", batch), head)
