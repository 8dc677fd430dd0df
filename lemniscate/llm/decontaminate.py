"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents inside one task.  Its words become symbols: words of the benchmark have numbers, a run
of other words is one separator that no phrase can cross.  The shard's suffix array gives the Burrows-Wheeler transform,
kept in a wavelet matrix whose ranks drive the backward search of all phrases at once; suffix positions are sampled, and an
occurrence walks backwards to the next sample.  Occurrences become word spans, which are merged for each document.

Nothing is shuffled: every shard meets the whole benchmark, a stated query set, in blocks of at most `block_words` words,
each a broadcast.  A worker keeps the blocks that it has met, so a larger benchmark is searched in passes of
`blocks_at_once` blocks (3.2 million words), with the documents written as a table in between.

Nulls and ties: a null text has no words; a benchmark item without words has no window; a null item_id is called "null";
items that repeat an id are one item; every input row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import as_bytes, drop_bytes, in_slices, long_id, stored

#: Bytes of words (ASCII digits and letters, all of UTF-8 beyond ASCII) lower-cased; all others become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; a suffix that is a prefix of another stands before it."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank: its first place
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]  # all members of groups of two and more
        place = np.flatnonzero(tied)
        if not len(place):
            return order
        own = order[place]
        then = rank[np.minimum(own + step, n)]
        key = rank[own] * (n + 1) + then + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[place] = own  # groups stay in their places, as their ranks are those places
        new[place] = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new[place])
        rank[own] = place[starts][np.cumsum(new[place]) - 1]
        step *= 2


class WaveletMatrix:
    """Bit levels of a sequence of symbols, most significant first, each stably parted into zeros and ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.before, self.zeros = [], []  # ones before each place; zeros of each level
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.before.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.before[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros_like(at)
        for k, (before, zeros) in enumerate(zip(self.before, self.zeros)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(one, zeros + before[at], at - before[at])
            low = np.where(one, zeros + before[low], low - before[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for before, zeros in zip(self.before, self.zeros):
            one = before[at + 1] > before[at]
            out = out << 1 | one
            at = np.where(one, zeros + before[at], at - before[at])
        return out


class FMIndex:
    """Backward search and locating over symbols 1 .. sigma - 1; 0 ends the text, 1 separates, and neither is in a phrase."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate([text, [0]])
        self.n, self.sigma = len(text), sigma
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        kept = (sa % sample == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.bwt.rank(symbol, at)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, rows of symbols that stand at the left and are `sizes` long."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(int(sizes.max(initial=0))):
            live = live[low[live] < high[live]]
            now = live[sizes[live] > k]
            symbol = phrases[now, sizes[now] - 1 - k]
            low[now], high[now] = self.back(symbol, low[now]), self.back(symbol, high[now])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            at = rows[left]
            kept = self.kept_before[at + 1] > self.kept_before[at]
            out[left[kept]] = self.samples[self.kept_before[at[kept]]] + steps
            left, at = left[~kept], at[~kept]
            rows[left] = self.back(self.bwt.access(at), at)
            steps += 1
        return out % self.n


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)]
            for a in range(max(1, len(symbols) - width + 1) if symbols else 0):
                windows.setdefault(tuple(symbols[a : a + width]), set()).add(item)
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.rows[k, : len(w)] = w
        self.items = [sorted(x) for x in windows.values()]
        self.sigma = len(self.number) + 2

    def hits(self, texts: Iterable[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, end, phrase) of every occurrence in a shard; a text's words become numbers before the next
        text is taken, so a shard's words are never held together."""
        if not len(self.rows):
            return
        number = self.number.get
        parts = [np.array([*(number(w, 1) for w in words), 1], np.int64) for words in texts]
        if not parts:
            return
        sizes = np.array([len(p) for p in parts])
        symbols = np.concatenate(parts)
        del parts
        own = np.flatnonzero((symbols > 1) | np.concatenate([[True], symbols[:-1] > 1]))  # one separator for each run
        if symbols.max(initial=1) == 1:
            return
        index = FMIndex(symbols[own], self.sigma)
        low, high = index.search(self.rows, self.sizes)
        counts = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), counts)
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at = own[index.locate(rows)]
        starts = np.cumsum(sizes) - sizes
        doc = np.searchsorted(starts, at, "right") - 1
        first = at - starts[doc]
        yield from zip(doc.tolist(), first.tolist(), (first + self.sizes[phrase]).tolist(), phrase.tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending, disjoint, not touching."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks; an item of more words than a block is a block alone."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator():
        text = row[1].encode()
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += n
    yield block


SPANS = "array<struct<a:int,b:int>>"


def passes(benchmark: DataFrame, width: int, block_words: int, at_once: int) -> Iterator[list[Broadcast]]:
    """The benchmark's blocks, each a broadcast, in groups of at most `at_once`."""
    group: list[Broadcast] = []
    for items in blocks_of(benchmark, block_words):
        if len(group) == at_once:
            yield group
            group = []
        group.append(benchmark.sparkSession.sparkContext.broadcast(Phrases(items, width)))
    yield group


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 200_000, shard_bytes: int = 6 << 20, blocks_at_once: int = 16) -> DataFrame:
    """(doc_id, text, n_words, spans: word positions [a, b) inside benchmark windows, items: ids of the items hit) of every row."""
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    names = ["doc_id", "text", "n_words", "spans", "items"]
    schema = f"doc_id long, text string, n_words long, spans {SPANS}, items array<string>"

    def search_for(blocks: list[Broadcast]):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, "text", shard_bytes):
                texts = [words_of(t) for t in as_bytes(batch.column("text"))]
                spans = [[(s["a"], s["b"]) for s in own] for own in batch.column("spans").to_pylist()]
                items = [set(own) for own in batch.column("items").to_pylist()]
                for block in blocks:
                    for doc, a, b, phrase in block.value.hits(texts):
                        spans[doc].append((a, b))
                        items[doc].update(block.value.items[phrase])
                spans = [[{"a": a, "b": b} for a, b in merged(s)] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(span)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=names)

        return search

    found = docs.select(long_id().alias("doc_id"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    done = None
    for blocks in passes(benchmark, width, block_words, blocks_at_once):
        if done is not None:  # the groups before are searched, so that their blocks can leave the workers
            found = stored(done)
        done = found.mapInArrow(search_for(blocks), schema)
    return done


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    return drop_bytes(text, [(places[s["a"]][0], places[s["b"] - 1][1]) for s in spans])


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 200_000, shard_bytes: int = 6 << 20, blocks_at_once: int = 16) -> DataFrame:
    """All columns of docs, with the hit spans cut out of `text`; documents without a hit are unchanged, a null text stays null."""
    shown = docs.withColumn("text", F.col("text").cast("string")).select(*docs.columns)
    at = "_spans"
    while at in docs.columns:
        at = f"_{at}"
    marked = StructType([*shown.schema.fields, StructField(at, ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])))])
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def search_for(blocks: list[Broadcast], first: bool, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, "text", shard_bytes):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                spans = [[] if first else [(s["a"], s["b"]) for s in own] for own in ([()] * len(texts) if first else batch.column(at).to_pylist())]
                for block in blocks:
                    for doc, a, b, _ in block.value.hits(words_of(t or b"") for t in texts):
                        spans[doc].append((a, b))
                spans = [[{"a": a, "b": b} for a, b in merged(own)] for own in spans]
                if not last:
                    table = pa.Table.from_batches([batch])
                    yield from (table if first else table.drop_columns([at])).append_column(at, pa.array(spans, kind)).to_batches()
                    continue
                for doc, own in enumerate(spans):
                    if own:
                        texts[doc] = without_spans(texts[doc], own)
                k = batch.schema.get_field_index("text")
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.binary()).cast(batch.schema.field(k).type))
                yield batch if first else batch.select([f.name for f in batch.schema if f.name != at])

        return search

    groups = list(passes(benchmark, width, block_words, blocks_at_once))
    for k, blocks in enumerate(groups):
        first, last = k == 0, k == len(groups) - 1
        found = shown if first else found
        found = found.mapInArrow(search_for(blocks, first, last), shown.schema if last else marked)
        found = found if last else stored(found)
    return found
