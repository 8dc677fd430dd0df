"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least `least`, connected.

Order all shingles from rare to frequent and call n - ceil(least * n) + 1 first ones of a set of n its prefix, and those of
them with at most n - ceil(2 * least * n / (1 + least)) before them its index prefix.  The first shingle that two similar
sets have in common stands in the prefix of the larger and in the index prefix of the smaller one, and neither has fewer
shingles from there on than the two must share (prefix and position filters).  So a set only meets sets of its size or less
at shingles of their index prefixes, and a row (set, shingle) that no such set can reach is dropped before any comparison: of
pages made from one template only those that may be near copies stay, however many there are.  Frequencies are counted
over all documents, in hash cells; a cell that several shingles share changes the order, never the result.

Equal sets are one node, known by 128 bits of hash.  A set's fingerprint has a bit for each hash cell, set where an odd
number of its shingles fall.  Two sets that differ in d shingles have fingerprints that differ in d bits at most, and similar
ones of sizes m and n differ in (m + n) * (1 - least) / (1 + least) shingles at most: that is the radius, and again no similar
pair is lost.  Blocks of one shingle are compared as the SimHash operator's are, in bit planes with carry-save counters,
abandoned words and sub-blocks.  Only pairs within the radius are verified, on the shingles themselves, in three rounds: each
text with one set, the hub, of each of its blocks; then each with the nearest text there that isn't yet in its component; then
all pairs that are left between different components.  So a large group of copies costs a few pairs for each member, not one
for each two.

Fingerprints have `CELLS_A_SHINGLE` bits a shingle and more, in powers of two from 512 to 16,384; beyond about 8,000
distinct shingles the filter is less sharp, which costs comparisons and changes no result.

Nulls and the like: a text of fewer words has one shingle of all its words, a null or empty one is a copy of every other such
text; words are split at ASCII white space, with A-Z lower-cased.  Ids that are no whole numbers count as null; rows that share
an id are told apart by their text's hash, and repeated rows stay rows of their own.  Very long texts are sets like any other.
Of ties the hub of the least node counts.  An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, long_id, mixed, stored
from .ngram_join import cell_of, frequencies, texts_of, token_sets
from .simhash import Blocks, components

#: Cells in which shingles are counted for their order.
CELLS = 1 << 24
#: Bits of fingerprints for each shingle, the smallest size, and how often it is doubled.
CELLS_A_SHINGLE, SMALLEST, DOUBLED = 4, 512, 5


def shingles(text: bytes, width: int = 5) -> set[bytes]:
    words = text.lower().split()
    width = max(1, min(width, len(words)))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def size_class(n: int) -> int:
    """Fingerprints of n shingles have SMALLEST << class bits."""
    return min(DOUBLED, max(0, (CELLS_A_SHINGLE * n - 1).bit_length() - SMALLEST.bit_length() + 1))


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """Bit k: is the number of hashes that fall in cell k odd?"""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(blobs: list[bytes], bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers, larger ones folded to `bits` bits: cells that fall together add up."""
    out = np.zeros((len(blobs), bits // 64), np.uint64)
    for k, blob in enumerate(blobs):
        own = np.frombuffer(blob, np.uint64)
        out[k] = np.bitwise_xor.reduce(own.reshape(-1, bits // 64), axis=0)
    return out


def needed(n: Column, m: Column, least: float) -> Column:
    """How many shingles sets of n and m must share."""
    return F.ceil((n + m) * F.lit(least / (1 + least)) - 1e-6)


def indexed(least: float) -> Column:
    """Does a row (n, at: the shingles before this one) stand in the index prefix?"""
    return F.col("n") - F.col("at") >= needed(F.col("n"), F.col("n"), least)


def prefixes(docs: DataFrame, levels: np.ndarray, width: int, least: float) -> DataFrame:
    """(doc_id, row: the text's hash, key: hash of the set, n: its size, fp: its fingerprint, own and lower: the size classes at
    which it is compared, prefix: its first shingles, blob: the words, compressed) of every row."""
    shared, cells = docs.sparkSession.sparkContext.broadcast(levels), len(levels)
    names = ["doc_id", "row", "key", "n", "fp", "own", "lower", "prefix", "blob"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in in_slices(batches, "text", 4 << 20):
            keys, sizes, prints, firsts = [], [], [], []
            for h in token_sets(batch.column("text"), width):
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                prints.append(fingerprint(h, SMALLEST << size_class(len(h))))
                order = np.argsort(shared.value[cell_of(h, cells)], kind="stable")
                firsts.append(h[order[: len(h) - ceil(least * len(h) - 1e-9) + 1]].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            blobs = [squeeze.compress(text) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(map(size_class, sizes), pa.int32()), pa.array([size_class(ceil(least * n - 1e-9)) for n in sizes], pa.int32()), lists, pa.array(blobs, pa.binary())], names=names)

    return docs.mapInArrow(sign, "doc_id long, row long, key binary, n int, fp binary, own int, lower int, prefix array<long>, blob binary")


def small_pairs(asking: DataFrame, asked: DataFrame, prints: DataFrame, least: float, small: int) -> DataFrame:
    """candidates() of blocks in which fewer than `small` nodes ask: their pairs, a few for each row, each tested once however
    many blocks it stands in."""
    by = ["size_class", "shingle"]
    few = asking.groupBy(*by).count().where(F.col("count") < small).select(*by)
    a, b = (rows.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at", "root")]) for s, rows in (("a", asking.join(few, by, "left_semi")), ("b", asked)))
    alike = (F.col("n_b") <= F.col("n_a")) & (F.col("n_b") >= F.lit(least) * F.col("n_a") - 1e-9)
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed(F.col("n_a"), F.col("n_b"), least)
    pairs = a.join(b, by).where((F.col("root_a") != F.col("root_b")) & alike & reach).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(prints.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("fp").alias(f"fp_{s}")), s)
    slack = (1 - least) / (1 + least)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy(zero_copy_only=False) + batch.column("n_b").to_numpy(zero_copy_only=False)
            far = np.zeros(batch.num_rows, np.int64)
            for k, both in enumerate(zip(batch.column("fp_a").to_pylist(), batch.column("fp_b").to_pylist())):
                x, y = folded(both, 8 * min(map(len, both)))
                far[k] = np.bitwise_count(x ^ y).sum(dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(far <= n * slack + 1e-6))

    return pairs.select("a", "b", "n_a", "n_b", "fp_a", "fp_b").mapInArrow(near, "a long, b long")


def dealt(asking: DataFrame, asked: DataFrame, most: Column, small: int) -> DataFrame:
    """Rows of blocks in which `small` and more ask, those asked with `right`, in sub-blocks (p, q): part p of those asked meets part q
    of those that ask, each of about `most` rows."""
    by = ["size_class", "shingle"]
    size = asking.groupBy(*by).agg(F.count("*").alias("asks")).where(F.col("asks") >= small)
    size = size.join(asked.groupBy(*by).agg(F.count("*").alias("answers")), by)
    size = size.select(*by, F.ceil(F.col("answers") / most).cast("int").alias("ps"), F.ceil(F.col("asks") / most).cast("int").alias("qs"))
    sides = []
    for rows, own, other, right in ((asking, "q", "p", False), (asked, "p", "q", True)):
        cut = F.pmod(F.xxhash64("node"), F.col(f"{own}s")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        sides.append(rows.join(size, by).select(*rows.columns, cut, every).withColumn("right", F.lit(right)))
    return sides[0].unionByName(sides[1])


def candidates(rows: DataFrame, prints: DataFrame, least: float, nearest: bool, block_rows: int = 4096, small: int = 8) -> DataFrame:
    """(a, b), a < b: pairs of nodes of different roots under one shingle whose fingerprints allow the similarity.

    rows: (shingle, at, node, n, root, own, lower); prints: (node, n, fp), which only rows of larger blocks and pairs of smaller
    ones are joined to.  With `nearest`, a node brings its nearest partner in each block only, but
    for blocks of fewer than `small` nodes.  A set asks those of its index prefix that are no larger.  Sets of two
    fingerprint sizes meet at the smaller one, so a set also asks those that are a class smaller if it may have a partner there.
    """
    asking = rows.withColumn("size_class", F.explode(F.array_distinct(F.array("own", "lower")))).drop("own", "lower")
    asked = rows.where(indexed(least)).withColumn("size_class", F.col("own")).drop("own", "lower")
    most = F.greatest(F.lit(float(min(64, block_rows))), block_rows / F.pow(F.lit(2.0), F.col("size_class")))
    by = ["size_class", "shingle", "p", "q"]
    blocks = dealt(asking, asked, most, small).join(prints.select("node", "fp"), "node").repartition(*by).sortWithinPartitions(*by)
    slack = (1 - least) / (1 + least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size_class", "shingle", "p", "q", "right", "node", "n", "at", "root"]
        kind = np.dtype([(c, bool if c == "right" else np.int64) for c in names])

        def found(table: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
            key = table[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            block, node, n, root = np.cumsum(new), table["node"], table["n"], table["root"]
            rest, fp = n - table["at"], folded(blobs, SMALLEST << int(table["size_class"][0]))
            parts = [np.zeros((3, 0), np.int64)]
            blocks = Blocks(fp, np.flatnonzero(new), np.zeros(len(n), bool), table["right"]) if table["right"].any() else None
            for i, j in blocks.near(np.floor(2 * n * slack + 1e-6).astype(np.int64)) if blocks else ():
                far = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)
                both = n[i] + n[j]
                ok = (far <= both * slack + 1e-6) & (root[i] != root[j]) & (n[j] <= n[i]) & (n[j] >= least * n[i] - 1e-9)
                ok &= np.minimum(rest[i], rest[j]) >= np.ceil(both * (least / (1 + least)) - 1e-6)
                parts.append(np.stack([i[ok], j[ok], far[ok]]))
            i, j, far = np.concatenate(parts, axis=1)
            a, b = node[i], node[j]
            if nearest:
                where, far = np.tile(block[i], 2), np.tile(far, 2)
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
                order = np.lexsort((b, far, a, where))
                a, b, where = a[order], b[order], where[order]
                first = np.concatenate([[True], (a[1:] != a[:-1]) | (where[1:] != where[:-1])])[: len(a)]
                a, b = a[first], b[first]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held, blobs = np.zeros(0, kind), []
        for batch in batches:
            table = np.zeros(batch.num_rows, kind)
            for name in names:
                table[name] = batch.column(name).to_numpy(zero_copy_only=False)
            held, blobs = np.concatenate([held, table]), blobs + batch.column("fp").to_pylist()
            while len(held):
                same = int(np.searchsorted(held["size_class"], held["size_class"][0], "right"))  # rows of the first class
                key = held[:same][by]
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                full = (4 * block_rows) >> int(held["size_class"][0])
                if same < len(held):
                    at = same if same <= full or not len(cuts) else int(cuts[max(0, np.searchsorted(cuts, full, "right") - 1)])
                elif same >= full and len(cuts):  # all blocks but the last, which may go on
                    at = int(cuts[max(0, np.searchsorted(cuts, full, "right") - 1)])
                else:
                    break
                yield found(held[:at], blobs[:at])
                held, blobs = held[at:], blobs[at:]
        if len(held):
            yield found(held, blobs)

    return blocks.select(*by, "right", "node", "n", "at", "root", "fp").mapInArrow(compare, "a long, b long").union(small_pairs(asking, asked, prints, least, small)).distinct()


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts: (id, blob)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            keep, last, left = [], None, set()
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"))):
                if a != last:
                    last, left = a, shingles(expand.decompress(x.as_py()), width)
                right = shingles(expand.decompress(y.as_py()), width)
                both = len(left & right)
                if both >= least * (len(left) + len(right) - both) - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("blob").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("blob").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def bit_of(shingle: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap's bit for each shingle, scrambled as prefixes are chosen by the hash's own upper bits."""
    return (mixed(shingle.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)).astype(np.int64)


def shared_shingles(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, set for the prefix shingles of several nodes.  A shingle is shuffled as four bytes."""
    part_bits = max(0, bits - 20)
    size = 1 << (bits - part_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.sort(bit_of(batch.column("prefix").flatten().to_numpy(), bits))
            cuts = np.searchsorted(bit, np.arange((1 << part_bits) + 1) * size)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([(bit[cuts[p] : cuts[p + 1]] - p * size).astype(np.uint32).tobytes() for p in some.tolist()], pa.binary())], names=["part", "found"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come one after the other; the bits of one are held."""
        own, once, again = None, np.zeros(size, bool), np.zeros(size, bool)
        as_row = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([np.packbits(again).tobytes()])], names=["part", "bits"])
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("found").to_pylist()):
                if part != own:
                    if own is not None:
                        yield as_row()
                    own, once, again = part, np.zeros(size, bool), np.zeros(size, bool)
                bit = np.frombuffer(found, np.uint32)
                again[bit[once[bit]]] = True
                again[bit[1:][bit[1:] == bit[:-1]]] = True
                once[bit] = True
        if own is not None:
            yield as_row()

    found = nodes.select("prefix").mapInArrow(emit, "part long, found binary").repartition("part").sortWithinPartitions("part")
    bitmap = np.zeros((1 << part_bits, size // 8), np.uint8)
    for row in found.mapInArrow(pack, "part long, bits binary").toLocalIterator():
        bitmap[row.part] = np.frombuffer(row.bits, np.uint8)
    return bitmap.ravel()


def prefix_rows(nodes: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows (node, n, own, lower, at, shingle) of the prefixes, without most shingles that one node alone has."""
    if bits is None:
        total = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
        bits = min(31, max(20, int(2 * total).bit_length()))
    bitmap = nodes.sparkSession.sparkContext.broadcast(shared_shingles(nodes, bits))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            shingle, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            bit = bit_of(shingle, bits)
            kept = np.flatnonzero(bitmap.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            row = np.repeat(np.arange(batch.num_rows), sizes)[kept]
            at = kept - (np.cumsum(sizes) - sizes)[row]
            of = batch.select(["node", "n", "own", "lower"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(at, pa.int32()), pa.array(shingle[kept])], names=[*of.schema.names, "at", "shingle"])

    return nodes.select("node", "n", "own", "lower", "prefix").mapInArrow(explode, "node long, n int, own int, lower int, at int, shingle long")


def met_at(nodes: DataFrame, least: float, bits: int | None = None) -> DataFrame:
    """Rows (shingle, at, node, n, own, lower, hub) of the nodes' prefixes that may have a partner under their shingle; hub is the
    least node (node, n, at) whose index prefix has it."""
    rows = prefix_rows(nodes, bits)
    hub = F.min(F.when(indexed(least), F.struct("node", "n", "at"))).alias("hub")
    low = F.min(F.when(indexed(least), F.col("n"))).alias("low")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("many"), hub, low).where("many > 1 AND hub IS NOT NULL").drop("many")
    smallest = F.greatest(F.col("low"), F.ceil(F.col("n") * least - 1e-9))  # the least set that this one can be like
    open_ = indexed(least) | ((F.col("low") <= F.col("n")) & (F.col("n") - F.col("at") >= needed(F.col("n"), smallest, least)))
    return rows.join(shared, "shingle").where(open_).drop("low")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, block_rows: int = 4096, small: int = 8, cells: int = CELLS, few: int = 250_000) -> DataFrame:
    """(doc_id, row: the text's xxhash64, node: number of its set of shingles, component_id: the least doc_id that similar pairs
    reach) of every row.  Keys of texts to fetch are broadcast while they are at most `few`; more of them are joined."""
    text = F.col("text").cast("string")
    rows = docs.select(long_id().alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    signed = stored(prefixes(rows, frequencies(rows, width, cells), width, least))
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "own", "lower", "fp", "prefix")])
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    prints, named_keys = nodes.select("node", "n", "fp"), nodes.select(F.col("node").alias("id"), "key")
    fetched = lambda pairs: texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), named_keys, signed, few)
    met = stored(met_at(nodes, least))
    n, m = F.col("n"), F.col("hub.n")
    fits = (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9) & (F.least(n - F.col("at"), m - F.col("hub.at")) >= needed(n, m, least))
    tried = met.where((F.col("hub.node") != F.col("node")) & fits)
    tried = stored(tried.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
    links = stored(similar(tried, fetched(tried), width, least))
    reached = stored(components(links))
    kept = ["shingle", "at", "node", "n", "own", "lower"]
    left = met.where(F.col("hub.node") != F.col("node")).select(*kept)  # a hub's pairs under its shingle are all tried or too unlike
    for nearest in (True, False):
        named = left.join(reached, "node", "left").select(*kept, F.coalesce("root", "node").alias("root"))
        mixed = named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
        open_ = stored(named.join(mixed, "shingle", "left_semi"))
        pairs = stored(candidates(open_, prints, least, nearest, block_rows, small).join(tried, ["a", "b"], "left_anti"))
        more = stored(similar(pairs, fetched(pairs), width, least))
        links, tried, left = links.union(more), tried.union(pairs), open_.select(*kept)
        reached = stored(components(links))
    classes = nodes.select("key", "node", "first").join(reached.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("key", "node", "first", F.coalesce("root", "node").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return signed.select("doc_id", "row", "key").join(classes.join(ids, "root").select("key", "node", "component_id"), "key").select("doc_id", "row", "node", "component_id")
