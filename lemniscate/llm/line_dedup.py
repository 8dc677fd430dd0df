"""Exact line deduplication over levelled sorted runs.

A run is a table of (key, n_docs, keeper), sorted by key.  Documents come in batches of descending doc_id.  A new batch
is merge-anti-joined with the runs: keys that no run holds are new, and their keeper is the batch's largest doc_id; for
keys already held only the number of documents is added (one left join tells both).  The batch's own run then joins level 0, and `fanout` runs of a
level are compacted into one run of the next.  After the last batch the runs hold, for each key, its documents' number and
the largest doc_id.

Nulls and ties: a null or empty text is one empty line; rows with a null doc_id count together as one document that is
smaller than all others; rows that repeat a doc_id count as one document; a text without a repeated key is unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, long_id, stored

#: Text of a batch, from four batches on.
BATCH_BYTES = 1 << 40
#: Stands for a null doc_id.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The levels, from the smallest runs to the largest; each run is a table in the shared folder."""

    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """lines: (id, key) of a batch whose ids are all smaller than those of earlier batches."""
        own = lines.groupBy("key").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        if held := self.runs():  # a key's keeper stands in one run only, so the join adds no rows
            known = reduce(DataFrame.union, [r.where(F.col("keeper").isNotNull()).select("key", F.lit(True).alias("known")) for r in held])
            own = own.join(known, "key", "left").select("key", "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self.put(0, stored(own.sortWithinPartitions("key")))

    def put(self, level: int, run: DataFrame) -> None:
        """Add a run; compact the level once it is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.put(level + 1, stored(merged(full).sortWithinPartitions("key")))

    def counts(self) -> DataFrame:
        return merged(self.runs())


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: a key's keeper stands in exactly one of them."""
    both = reduce(DataFrame.union, runs)
    return both if len(runs) == 1 else both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def row_key() -> tuple[Column, Column]:
    """What names a row: its doc_id, and its text's hash for rows that share an id."""
    return F.coalesce(long_id(), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("row")


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """(id, row: the text's hash, drop: sorted positions of the lines to drop) of every document that loses lines.

    There are `batches`, or one for each `BATCH_BYTES` of text, four at least.
    """
    if batches is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
        batches = max(4, int(size // BATCH_BYTES))
    rows = docs.select(*row_key(), F.posexplode(lines_of(F.col("text").cast("string"))).alias("pos", "line"))
    keyed = rows.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    ids = docs.select(F.coalesce(long_id(), F.lit(NO_ID)).alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = sum((F.when(F.col("id") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    lines = stored(keyed.select("id", "row", "pos", F.unhex(F.md5("line")).alias("key"), batch.alias("batch")), "batch")
    runs = LineRuns(fanout)
    for b in range(len(cuts), -1, -1):
        runs.add(lines.where(F.col("batch") == b).select("id", "key"))
    often = runs.counts().where(F.col("n_docs") >= min_docs).select("key", "keeper")
    doomed = lines.select("id", "row", "pos", "key").join(often, "key").where(F.col("id") != F.col("keeper"))
    return doomed.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def without_repeated_lines(docs: DataFrame, **limits) -> DataFrame:
    """All columns of docs (`text` with its repeated lines dropped), then n_lines (before) and n_dropped.

    Columns of docs that are called n_lines or n_dropped are replaced.  A null text stays null when nothing is dropped.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = repeated_lines(docs, **limits)
    own = docs.select(F.struct("*").alias("all"), *row_key()).join(drops, ["id", "row"], "left")
    text = F.col("all.text").cast("string")
    kept = without_lines()(F.when(F.col("drop").isNotNull(), text), F.col("drop"))
    held = [F.when(F.col("drop").isNull(), text).otherwise(F.col("kept")).alias("text") if c == "text" else F.col("all").getField(c).alias(c) for c in docs.columns]
    counts = F.size(lines_of(text)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")
    return own.withColumn("kept", kept).select(*held, *counts)


def without_lines() -> Callable[[Column, Column], Column]:
    """(text, positions) -> text without these lines, in time that is linear in both.  Array functions would look through
    all positions, or copy all lines, once for each line; texts that keep all their lines don't come here."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for text, drop in zip(texts, drops):
            if text is None or drop is None:
                out.append(None)
                continue
            lines = text.split("\n")
            keep = np.ones(len(lines), bool)
            keep[np.asarray(drop, np.int64)] = False
            out.append("\n".join(lines[i] for i in np.flatnonzero(keep).tolist()))
        return pd.Series(out, dtype=object)

    return cut
