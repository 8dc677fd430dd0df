"""SimHash near-duplicates: fingerprints, bit-sliced comparison within pigeonhole blocks, connected components.

Two fingerprints within `radius` differing bits agree on all but `radius` of their disjoint pieces, so each distinct
fingerprint goes to one block for every choice of the other pieces.  A block keeps its fingerprints as 64 vertical bit planes (64
fingerprints to a machine word).  One fingerprint is compared with all the others at once: plane by plane the differing
bits run through a carry-save counter, and words of lanes whose 64 distances all exceed the radius are abandoned.
A block gives one link for each fingerprint that isn't the first of its group there, never all pairs.  Blocks of more
than `block_rows` fingerprints are cut into sub-blocks, and each pair of sub-blocks is compared in a task of its own.

Nulls and ties: null and empty texts have fingerprint 0 and link like any other; equal fingerprints are one node; rows
with a null doc_id take part, and a component of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, long_id, stored

BITS = 64


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; a text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp: the fingerprint's 64 bits as a signed long) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            fps = np.array([simhash(t, width, seed) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(long_id().alias("doc_id"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, fp long")


class BitPlanes:
    """Bit vectors stored vertically: planes[b] holds bit b of all of them, 64 lanes to a word."""

    def __init__(self, lanes: np.ndarray, used: np.ndarray):
        """lanes: a row of 64-bit numbers for each vector, or one number for each."""
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(used), -1), axis=1, bitorder="little")  # row: vector; column: bit
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        self.used = np.packbits(used, bitorder="little").view(np.uint64)

    def within(self, asked: np.ndarray, words: np.ndarray, radius: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, lane) for every lane of words[k] whose distance to asked[k] is at most the radius (one, or one for each k).

        Eight planes at a time run through a tree of carry-save adders; only its last carry goes on to the higher digits.
        """
        asked = asked.reshape(len(words), -1)
        radius = np.broadcast_to(np.asarray(radius, np.int64), len(words))
        left = np.arange(len(words))
        over = ~self.used[words]  # lanes that have left for good
        counter = [np.zeros(len(words), np.uint64) for _ in range(max(4, int(radius.max(initial=0)).bit_length()))]
        ones, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
        check = max(8, len(self.planes) // 16)  # planes from one look for words to abandon to the next
        for group in range(0, len(self.planes), 8):
            bits = asked[:, group // 64] >> np.uint64(group % 64)
            d = [self.planes[group + b][words] ^ (np.uint64(0) - (bits >> np.uint64(b) & one)) for b in range(8)]
            counter[0], two_a = added(counter[0], d[0], d[1])
            counter[0], two_b = added(counter[0], d[2], d[3])
            counter[1], four_a = added(counter[1], two_a, two_b)
            counter[0], two_a = added(counter[0], d[4], d[5])
            counter[0], two_b = added(counter[0], d[6], d[7])
            counter[1], four_b = added(counter[1], two_a, two_b)
            counter[2], carry = added(counter[2], four_a, four_b)
            for k in range(3, len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if group % check == check - 8:
                gone = over | above(counter, radius)
                alive = np.flatnonzero(gone != ones)
                if 2 * len(alive) < len(words):  # abandon words without a lane within the radius
                    left, words, asked, radius, over, counter = left[alive], words[alive], asked[alive], radius[alive], over[alive], [c[alive] for c in counter]
                    if not len(words):
                        break
        near = ~(over | above(counter, radius))
        some = np.flatnonzero(near)
        row, lane = np.nonzero(np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return left[some[row]], words[some[row]] * BITS + lane


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in each lane."""
    both = a ^ b
    return both ^ c, a & b | both & c


def above(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose counter exceeds the radius of their word."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        digit = np.uint64(0) - (radius >> k & 1).astype(np.uint64)  # all ones or all zeros
        more |= same & counter[k] & ~digit
        same &= ~(counter[k] ^ digit)
    return more


class Blocks:
    """Rows of several blocks, whose right-hand rows stand in bit planes; in a block of its own, every row does."""

    def __init__(self, vectors: np.ndarray, starts: np.ndarray, own: np.ndarray, right: np.ndarray):
        n = len(vectors)
        self.vectors = vectors
        block = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        target = right | own
        seen = np.cumsum(target) - target
        rank = seen - seen[starts][block]
        words = -(-np.add.reduceat(target.astype(np.int64), starts) // BITS)
        ends = np.cumsum(words)
        first = (ends - words)[block]
        size = int(ends[-1]) * BITS
        lanes, used, self.row_of = np.zeros((size, *vectors.shape[1:]), np.uint64), np.zeros(size, bool), np.zeros(size, np.int64)
        at = (first * BITS + rank)[target]
        lanes[at], used[at], self.row_of[at] = vectors[target], True, np.flatnonzero(target)
        self.planes = BitPlanes(lanes, used)
        self.asks = np.flatnonzero(~right)
        self.begin = np.where(own, first + rank // BITS, first)[self.asks]  # in a block of its own a row meets those from its word on
        self.many = ends[block][self.asks] - self.begin

    def near(self, radius: int | np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): rows within the radius of row i, in parts."""
        total, a = np.cumsum(self.many), 0
        while a < len(self.asks):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
            rows, words = np.repeat(self.asks[a:z], self.many[a:z]), np.repeat(self.begin[a:z], self.many[a:z])
            words += np.arange(len(rows)) - np.repeat(np.cumsum(self.many[a:z]) - self.many[a:z], self.many[a:z])
            k, lane = self.planes.within(self.vectors[rows], words, radius if np.isscalar(radius) else radius[rows])
            yield rows[k], self.row_of[lane]
            a = z


def block_links(fp: np.ndarray, starts: np.ndarray, own: np.ndarray, right: np.ndarray, radius: int, at_once: int = 1 << 18) -> list[tuple[int, int]]:
    """Positions (i, j) whose links connect all pairs within radius of every block.

    Blocks begin at `starts`.  In a block of its own, every row meets every row; else the rows with `right` meet the others.
    """
    label, links = np.arange(len(fp)), []
    for i, j in Blocks(fp, starts, own, right).near(radius, at_once):
        while len(open_ := np.flatnonzero(label[i] != label[j])):
            i, j = i[open_], j[open_]
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            high, k = np.unique(high, return_index=True)
            links += zip(i[k].tolist(), j[k].tolist())
            parent = np.arange(len(fp))
            parent[high] = low[k]
            while (parent != (up := parent[parent])).any():
                parent = up
            label = parent[label]
    return links


def in_sub_blocks(rows: DataFrame, keys: list[str], id_col: str, parts: Column, least: int = 2) -> DataFrame:
    """The rows of every block of `least` rows and more, dealt to pairs (p, q) of its sub-blocks: left of all q > p, right of all q < p.

    parts: how many sub-blocks a block has, over its `count`.
    """
    size = rows.groupBy(*keys).count().where(F.col("count") >= least).withColumn("parts", parts.cast("int")).drop("count")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(id_col), F.col("parts"))).otherwise(0).cast("int")
    dealt = rows.join(size, keys).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*rows.columns, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("right"))


def near_links(nodes: DataFrame, radius: int = 3, block_rows: int = 4096, pieces: int = 5) -> DataFrame:
    """(a, b): links between the distinct longs of nodes.fp whose connected components are those of all pairs within radius.

    Fingerprints are cut into `pieces` of about equal size.  Two of them within the radius agree on pieces - radius pieces,
    so each fingerprint stands in one block for every choice of that many: ten blocks of 25 bits and more for 5 pieces, at
    any size of the corpus.  More pieces make more copies and smaller blocks (6: 20 blocks of 31 bits and more).
    """
    if not radius:  # equal fingerprints are one node already
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    pieces = max(pieces, radius + 1)
    edges = [BITS * k // pieces for k in range(pieces + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(pieces), pieces - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = [F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.band", "key.value")
    pairs = in_sub_blocks(rows, ["band", "value"], "fp", F.ceil(F.col("count") / block_rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("band", np.int64), ("value", np.int64), ("p", np.int64), ("q", np.int64), ("fp", np.int64), ("right", bool)])

        def links(table: np.ndarray) -> pa.RecordBatch:
            fp = table["fp"].view(np.int64).astype(np.uint64)
            key = table[["band", "value", "p", "q"]]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            found = np.array(block_links(fp, starts, table["p"] == table["q"], table["right"], radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(table["fp"][found[:, k]]) for k in (0, 1)], names=["a", "b"])

        held = np.zeros(0, kind)
        for batch in batches:
            table = np.zeros(batch.num_rows, kind)
            for name in kind.names:
                table[name] = batch.column(name).to_numpy(zero_copy_only=False)
            held = np.concatenate([held, table])
            key = held[["band", "value", "p", "q"]]
            cuts = np.flatnonzero(key[1:] != key[:-1])
            if len(held) >= 4 * block_rows and len(cuts):  # all blocks but the last, which may go on
                yield links(held[: cuts[-1] + 1])
                held = held[cuts[-1] + 1 :]
        if len(held):
            yield links(held)

    by = ["band", "value", "p", "q"]
    return pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root: the least node of its component) of every node in links (a, b), by alternating star contractions.

    Each round points every node at the least node that it sees, first among its larger neighbours, then among the
    smaller ones; it ends when a round changes nothing.  Each round's links become a table, which ends their lineage.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signature = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1)), F.lit(0))).first()
    before = signature(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small)
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3, block_rows: int = 4096, pieces: int = 5) -> DataFrame:
    """(doc_id, fp, component_id: the least doc_id that links reach) of every row."""
    signed = stored(fingerprints(docs, width, seed))
    nodes = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(near_links(nodes.select("fp"), radius, block_rows, pieces))
    classes = nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")
