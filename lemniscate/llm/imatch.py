"""I-Match fingerprints over several randomised lexicons.

The lexicon is the band of terms whose normalised inverse document frequency, ln(N / df) / ln N, is at least `min_idf` (and
at most 1: a term seen at all).  Each lexicon subset keeps a share of it, chosen by the term's hash: level j has `subsets`
disjoint subsets that keep a term with chance 4**-j / subsets each.  For each subset, a text's distinct terms inside it are
sorted and hashed to 16 bits, 0 if there are none.  A text whose terms all fall out of the band uses all its terms.

Likeness of two fingerprints is the share of equal hashes among the subsets that are not empty in both, on the level where
it is largest among those with at least `min_used` such subsets (the first level, if none has); equal fingerprints have 1.

What is broadcast is the stop list, the terms below the band.  A term below it is in more than N**(1 - min_idf) documents,
so with t distinct terms in a document on average there are fewer than t * N**min_idf of them (about half a million terms
at ten thousand million documents and min_idf 0.3); the operator counts the list and refuses to broadcast more than
`max_stop` terms.

Nulls and ties: a null text is an empty one, whose fingerprint is all zeros; rows that share a doc_id are ordered by their
text's hash; a null doc_id comes first; repeated rows have equal fingerprints.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, long_id, mixed

NO_ID = -(2**63)


def stop_terms(docs: DataFrame, min_idf: float, max_stop: int) -> frozenset[bytes]:
    """Terms of too many documents.  Counts run over all documents; tasks send a row for each of their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 16 << 20):
            seen: Counter[bytes] = Counter()
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(set((text or b"").lower().split()))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    n = docs.count()
    if n < 2:
        return frozenset()
    limit = n ** (1 - min_idf)
    often = docs.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") > limit)
    rows = often.select("term").limit(max_stop + 1).collect()
    if len(rows) > max_stop:
        raise ValueError(f"more than {max_stop} terms lie below the band: choose a smaller min_idf")
    return frozenset(bytes(r.term) for r in rows)


class Lexicons:
    """The randomised lexicon subsets."""

    def __init__(self, stop: frozenset[bytes], levels: int = 6, subsets: int = 16, min_used: int = 6):
        self.stop, self.levels, self.subsets, self.min_used = stop, levels, subsets, min_used

    def fingerprints(self, texts: list[bytes]) -> np.ndarray:
        """A row of levels * subsets 16-bit hashes for each text."""
        hashes: dict[bytes, int] = {}
        terms, sizes = [], []
        for text in texts:
            all_terms = set(text.lower().split())
            own = all_terms - self.stop or all_terms
            sizes.append(len(own))
            for t in own:
                if t not in hashes:
                    hashes[t] = xxhash.xxh64_intdigest(t)
            terms += map(hashes.__getitem__, own)
        h = mixed(np.array(terms, np.uint64))
        doc = np.repeat(np.arange(len(texts)), sizes)
        subset = (h % np.uint64(self.subsets)).astype(np.int64)
        share = h >> np.uint64(64 - 2 * self.levels)  # its leading zero bits, two by two, say how deep the term goes
        out = np.zeros(len(texts) * self.levels * self.subsets, np.uint16)
        for level in range(self.levels):
            deep = np.flatnonzero(share >> np.uint64(2 * (self.levels - level)) == 0)
            if not len(deep):
                break
            place = (doc[deep] * self.levels + level) * self.subsets + subset[deep]
            key = np.sort(place.astype(np.uint64) << np.uint64(32) | mixed(h[deep] + np.uint64(level)) >> np.uint64(32))
            place = (key >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            rank = np.arange(len(key)) - np.repeat(starts, np.diff([*starts, len(key)]))
            word = mixed(key & np.uint64(0xFFFFFFFF) ^ mixed(rank.astype(np.uint64)))
            out[place[starts]] = (np.add.reduceat(word, starts) >> np.uint64(48)).astype(np.uint16) | 1
        return out.reshape(len(texts), self.levels * self.subsets)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = (len(a), self.levels, self.subsets)
        used = ((a | b) != 0).reshape(shape).sum(axis=2)
        same = ((a == b) & (a != 0)).reshape(shape).sum(axis=2)
        share = same / np.maximum(used, 1)
        best = np.where(used >= self.min_used, share, -1).max(axis=1)
        return np.where((a == b).all(axis=1), 1.0, np.where(best < 0, share[:, 0], best))


def hexes(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def fingerprints(docs: DataFrame, min_idf: float = 0.3, max_stop: int = 2_000_000) -> DataFrame:
    """(doc_id, fingerprint) of every row; no shuffle but that of the term counts."""
    docs = docs.select("doc_id", F.col("text").cast("string"))
    lexicons = docs.sparkSession.sparkContext.broadcast(Lexicons(stop_terms(docs, min_idf, max_stop)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 4 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexes(lexicons.value.fingerprints(texts)))], names=["doc_id", "fingerprint"])

    return docs.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def beside_next(docs: DataFrame, rows_a_block: int = 2048) -> DataFrame:
    """(block, id, look, tie, packed text): documents dealt into doc_id ranges, each range followed by the next range's first.

    Range bounds are as few as shuffle partitions of that many rows would be, and at most 4096.
    """
    rows = docs.select(F.coalesce(long_id(), F.lit(NO_ID)).alias("id"), long_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    blocks = min(4096, max(1, math.ceil(n / rows_a_block)))
    cuts = sorted({int(c) for c in rows.approxQuantile("id", [i / blocks for i in range(1, blocks)], 1 / (8 * blocks))}) if blocks > 1 else []
    block = F.expr("0")
    if cuts:
        array = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 64 else None
        block = F.size(F.filter(array, lambda c: c <= F.col("id"))) if array is not None else F.size(F.filter(F.from_json(F.lit(str(cuts)), "array<bigint>"), lambda c: c <= F.col("id")))
    first = sorted(r.first for r in rows.select("id", block.alias("block")).groupBy("block").agg(F.min("id").alias("first")).collect())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        names = ["block", "look", "id", "tie", "doc_id", "packed"]
        for batch in in_slices(batches, "text", 4 << 20):
            out = []
            for i, doc_id, text in zip(batch.column("id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                packed, tie = squeeze.compress(text or b""), xxhash.xxh64_intdigest(text or b"") >> 1
                own = bisect.bisect_right(first, i) - 1
                out.append((own, False, i, tie, doc_id, packed))
                if i == first[own]:  # also what follows the range before, or the last one
                    out.append(((own - 1) % len(first), True, i, tie, doc_id, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    return rows.mapInArrow(deal, "block int, look boolean, id long, tie long, doc_id long, packed binary")


def edited(text: str, then: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many (or all) of the next document's."""
    q = len(text) // 4
    return text[: len(text) - q] + then[:q]


def with_edits(docs: DataFrame, min_idf: float = 0.3, max_stop: int = 2_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one of the next larger doc_id; after the last comes the first.  Texts are shuffled once,
    compressed, into doc_id ranges.
    """
    docs = docs.select("doc_id", F.col("text").cast("string"))
    lexicons = docs.sparkSession.sparkContext.broadcast(Lexicons(stop_terms(docs, min_idf, max_stop)))
    dealt = beside_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, open_ = lexicons.value, zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, bool, int | None, str]]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    for block, look, doc_id, packed in zip(*(part.column(c).to_pylist() for c in ("block", "look", "doc_id", "packed"))):
                        yield block, look, doc_id, open_.decompress(packed).decode()

        held: list[tuple[int | None, str]] = []  # documents whose next is known once another comes
        size, block = 0, None

        def answer(own: list[tuple[int | None, str]], then: str) -> pa.RecordBatch:
            texts = [t for _, t in own]
            edits = [edited(a, b).encode() for a, b in zip(texts, [*texts[1:], then])]
            prints = lex.fingerprints([t.encode() for t in [*texts, then]])
            changed = lex.fingerprints(edits)
            own_prints = prints[:-1]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array(hexes(own_prints)), pa.array(hexes(changed)), pa.array(lex.likeness(own_prints, changed)), pa.array(lex.likeness(own_prints, prints[1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        done = False  # the block's first document of the next range has come
        for own, look, doc_id, text in rows():
            if own != block:
                block, done = own, False
            if look:
                if not done and held:
                    yield answer(held, text)
                held, size, done = [], 0, True
                continue
            if size > 2 << 20:
                yield answer(held, text)
                held, size = [], 0
            held.append((doc_id, text))
            size += len(text)

    by = ["block", "look", "id", "tie"]
    return dealt.repartition("block").sortWithinPartitions(*by).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
