"""Language identification as a mixture: expectation-maximisation over byte trigram likelihoods.

Learning counts hashed byte trigrams for each language over all labelled rows.  A document is cut into segments of
`segment` bytes; a segment's likelihood in a language is the product of its trigrams'.  EM estimates the document's
language proportions, first over all languages, then over its k likeliest ones for k = 1, 2, ...; the k of the best
likelihood less `penalty * log(segments + 1)` for each language after the first is its language set.  k runs up to all
learned languages, or until not even the best language of every segment could pay for one more.

The counts of a language are one array of `2 ** bits` numbers, so what is collected and broadcast is bounded by the number
of languages, which must not exceed `max_languages`.

Nulls and ties: a null text, or one without a letter, is `und` with score 0; rows without a language teach nothing; equal
proportions go to the first language in order; with nothing learned every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices
from .decontaminate import FOLD

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    return len(text) != len(text.translate(None, LETTERS)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def trigrams(text: bytes, bits: int) -> np.ndarray:
    """Hashed trigrams of a text between spaces, letters and digits lower-cased and all else a space."""
    b = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    with np.errstate(over="ignore"):
        return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


@dataclass
class Model:
    bits: int
    languages: list[str]
    loglik: np.ndarray  # of each trigram (row) in each language


def fit(docs: DataFrame, bits: int = 16, smooth: float = 0.5, max_languages: int = 512) -> Model:
    """Learn from text and lang of all rows that have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in in_slices(batches, "text", 8 << 20):
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << bits, np.int64)
                counts[lang] += np.bincount(trigrams(text, bits), minlength=1 << bits) if len(text) > 1 << 14 else 0
                if len(text) <= 1 << 14:
                    np.add.at(counts[lang], trigrams(text, bits), 1)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "gram", "n"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    total = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = total.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    languages, columns = [], []
    for row in table.orderBy("lang").limit(max_languages + 1).toLocalIterator():
        own = np.full(1 << bits, smooth)
        own[[g.gram for g in row.grams]] += [g.n for g in row.grams]
        languages.append(row.lang)
        columns.append(np.log(own / own.sum()))
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return Model(bits, languages, np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((1 << bits, 0), np.float32))


def mixture(loglik: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each document; loglik: a row of languages for each segment, documents at `starts`."""
    sizes = np.diff([*starts, len(loglik)])
    doc = np.repeat(np.arange(len(starts)), sizes)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    best = np.where(allowed[doc], loglik, -np.inf).max(axis=1)
    like = np.where(allowed[doc], np.exp(np.maximum(loglik - best[:, None], -80)), 0)
    for _ in range(rounds):
        joint = like * share[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
    total = np.add.reduceat(np.log((like * share[doc]).sum(axis=1)) + best, starts)
    return share, total


def infer(model: Model, texts: list[bytes], segment: int = 96, penalty: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen language set, the set as a mask) of each text, which must not be empty."""
    parts, sizes = [], []
    for text in texts:
        g = trigrams(text, model.bits)
        for a in range(0, len(g), segment << 10):  # some segments at a time: a row of languages for each trigram takes room
            own = g[a : a + (segment << 10)]
            parts.append(np.add.reduceat(model.loglik[own], np.arange(0, len(own), segment), axis=0, dtype=np.float64))
        sizes.append(-(-len(g) // segment))
    loglik = np.concatenate(parts)
    starts = np.cumsum(sizes) - sizes
    n = len(model.languages)
    full, _ = mixture(loglik, starts, np.ones((len(texts), n), bool), rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, share, chosen = np.full(len(texts), -np.inf), full, np.zeros((len(texts), n), bool)
    sizes, at_most, going = np.array(sizes), np.add.reduceat(loglik.max(axis=1), starts), np.arange(len(texts))
    for k in range(1, n + 1):
        price = penalty * (k - 1) * np.log(sizes + 1)
        going = going[at_most[going] - price[going] > best[going]]  # no set has more than each segment's best language gives
        if not len(going):
            break
        own_sizes, allowed = sizes[going], rank[going] < k
        own, total = mixture(loglik[np.repeat(np.isin(np.arange(len(texts)), going), sizes)], np.cumsum(own_sizes) - own_sizes, allowed, rounds)
        value = total - price[going]
        better = value > best[going]
        at = going[better]
        best[at], share[at], chosen[at] = value[better], own[better], allowed[better]
    return share, chosen


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score: its proportion, languages: the chosen set with proportions) of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in in_slices(batches, "text", 1 << 20):
            texts = as_bytes(batch.column("text"))
            lettered = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if lettered:
                share, chosen = infer(model, [texts[i] for i in lettered])
                for k, i in enumerate(lettered):
                    top = int(np.argmax(share[k]))
                    pred[i], score[i] = model.languages[top], float(min(1.0, share[k, top]))
                    sets[i] = [{"lang": model.languages[j], "share": float(share[k, j])} for j in np.flatnonzero(chosen[k]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(pred), pa.array(score), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=[id_col, "lang_pred", "score", "languages"])

    rows = docs.select(id_col, F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
