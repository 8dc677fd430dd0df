"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed words and word beginnings, fitted on labelled documents.  Where a labelled text mentions an
identity term, its sentences are also read with the term swapped for each other term of its group; the fit penalises the
squared change of the score's logit, so that a group's mention alone moves no score.

The fit runs on the driver over at most `max_rows` labelled rows, those of the smallest id hashes.  Each task sends a row's
distinct feature numbers; features that the classes don't tell apart (|z| below `min_z`) are left out, but identity
terms never are.  Weights are one array of `2 ** bits` floats, broadcast.

Nulls and ties: a null text is empty and has the model's bias as its score; labels that are null are left out; of a doc_id
labelled more than once the largest label counts; without any labelled row every score is 0; with one class only, every
score is the smoothed share of that class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import as_bytes, in_slices
from .decontaminate import words_of

#: Groups of identity terms that may be swapped for each other; each has a neutral word.
IDENTITY = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "single"),
    ("immigrant", "refugee", "foreigner", "citizen", "resident"),
    ("immigrants", "refugees", "foreigners", "citizens", "residents"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
SENTENCE = re.compile(rb"[.!?\n]+")


def features(word: bytes, bits: int) -> tuple[int, ...]:
    """Numbers of a word and of its beginnings of four to six bytes."""
    mask = (1 << bits) - 1
    return (zlib.crc32(word) & mask, *(zlib.crc32(word[:n] + b"*") & mask for n in (4, 5, 6) if len(word) > n))


def swaps(text: bytes, groups: Sequence[Sequence[str]]) -> set[tuple[bytes, bytes]]:
    """(term, other term) for every swap that a sentence of the text allows."""
    partner = {t.encode(): [o.encode() for o in g if o != t] for g in groups for t in g}
    return {(w, o) for sentence in SENTENCE.split(text) for w in words_of(sentence) if w in partner for o in partner[w]}


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    bias: float

    def score(self, active: set[int]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.bias + float(sum(self.weights[f] for f in sorted(active))), -30, 30)))


class Active(dict):
    """The features of each word that have a weight; at most `keep` words are remembered."""

    def __init__(self, model: Model, keep: int = 500_000):
        self.model, self.keep = model, keep

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.keep:
            self.clear()
        found = self[word] = tuple(f for f in features(word, self.model.bits) if self.model.weights[f])
        return found


def examples(docs: DataFrame, labels: DataFrame, label_col: str, may_learn: Column, max_rows: int, bits: int, groups) -> DataFrame:
    """(label, features, cut, added: feature lists of each counterfactual) of the labelled rows that the fit reads."""
    own = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).where(may_learn).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            found, pairs = [], []
            for text in as_bytes(batch.column("text")):
                own = set(words_of(text))
                found.append(sorted({f for w in own for f in features(w, bits)}))
                change = []
                for a, b in sorted(swaps(text, groups)):
                    before = {f for w in own for f in features(w, bits)}
                    after = {f for w in (own - {a}) | {b} for f in features(w, bits)}
                    change.append({"cut": sorted(before - after), "added": sorted(after - before)})
                pairs.append(change)
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, numbers), pa.array(pairs, pa.list_(pa.struct([("cut", numbers), ("added", numbers)])))], names=["label", "features", "swaps"])

    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(own), "doc_id").select("label", "text")
    return rows.mapInArrow(read, "label int, features array<int>, swaps array<struct<cut:array<int>,added:array<int>>>")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label_col: str = "toxic", groups: Sequence[Sequence[str]] = IDENTITY, penalty: float = 1.0, ridge: float = 1e-4, min_z: float = 4.0, max_rows: int = 8192, bits: int = 20, rounds: int = 400) -> Model:
    """Fit on the labelled rows for which may_learn (over labels' columns) holds."""
    rows = examples(docs, labels, label_col, F.lit(True) if may_learn is None else may_learn, max_rows, bits, groups).toArrow()
    y = rows.column("label").to_numpy(zero_copy_only=False).astype(float)
    weights = np.zeros(1 << bits, np.float32)
    if not len(y):
        return Model(bits, weights, -30.0)
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Model(bits, weights, float(np.log(share / (1 - share))))
    lists = rows.column("features").combine_chunks()
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    pos, n1 = np.bincount(flat, y[row], 1 << bits), y.sum()
    both, n = np.bincount(flat, minlength=1 << bits), len(y)
    mean = both / n
    with np.errstate(all="ignore"):
        z = np.nan_to_num((pos / n1 - (both - pos) / (n - n1)) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / (n - n1))))
    kept = np.abs(z) >= min_z
    kept[[f for g in groups for t in g for f in features(t.encode(), bits)]] = True
    number = np.cumsum(kept) - 1
    use = kept[flat]
    flat, row = number[flat[use]], row[use]
    change = [(sign, k, number[f]) for k, s in enumerate(s for own in rows.column("swaps").to_pylist() for s in own) for sign, fs in ((-1.0, s["cut"]), (1.0, s["added"])) for f in fs if kept[f]]
    sign, pair, swapped = (np.array(c) for c in zip(*change)) if change else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    pairs = int(pair.max()) + 1 if len(pair) else 1
    w, b = np.zeros(int(kept.sum())), 0.0
    weight = np.where(y > 0, n / (2 * n1), n / (2 * (n - n1)))  # both classes count alike
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.05
    for t in range(1, rounds + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[flat], n), -30, 30))) - y)
        moved = np.bincount(pair, sign * w[swapped], pairs)
        grad = np.append(np.bincount(flat, error[row], len(w)) / n + ridge * w + penalty * np.bincount(swapped, sign * moved[pair], len(w)) / pairs, error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[kept] = np.where(np.abs(w) < 1e-3, 0, w)
    return Model(bits, weights, float(b))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, then score and predicted (columns of these names are replaced); no shuffle."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = Active(shared.value)
        for batch in in_slices(batches, "text", 8 << 20):
            scores = []
            for text in as_bytes(batch.column("text")):
                own: set[int] = set()
                for word in set(words_of(text)):
                    if found := active[word]:
                        own.update(found)
                scores.append(shared.value.score(own))
            table = pa.Table.from_batches([batch]).append_column("score", pa.array(scores, pa.float64())).append_column("predicted", pa.array([int(s >= threshold) for s in scores], pa.int32()))
            yield from table.to_batches()

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
