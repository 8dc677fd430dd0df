"""N-gram Jaccard join: all documents whose sets of word n-grams have a Jaccard similarity of `least` or more, connected.

Token-group matrix: similar documents stand together in groups, and each group is stored with the union of its members'
n-grams.  What a query shares with the union bounds what it can share with any member, so only groups whose bound reaches
the least overlap are opened and their members compared.

Which query meets which group: order all n-grams from rare to frequent.  If x and y are similar and y is not the larger one,
a `probe` prefix of x and a shorter `index` prefix of y have an n-gram in common, whatever the order; so only groups that hold
one of a query's probe n-grams in a member's index prefix are looked at, and queries of one group go there together.  Frequencies
are counted over all documents in hash cells; a cell that several n-grams share changes the order, never the result.

Three steps.  (1) Every document is compared with one other, the hub, of each n-gram of its prefix; this connects
large families of copies at a few comparisons a member.  (2) N-grams whose documents are not all connected by then are open;
their documents form groups of about `members`: those of one component, or else of equal min-hashes, larger ones split by
a hash of the id.  Pairs of groups meet in the matrix, not pairs of documents.  (3) A pair of groups is bounded and, if it
must be, opened, and one link is enough for two components.  So no link between different texts is lost and a family of
any size never becomes all of its pairs.

Equal sets are one node, known by 128 bits of hash.  N-grams are compared by 64 bits.  What is broadcast: a byte for each cell, and
keys of documents to fetch while they are at most `small`; more of them are joined.

Nulls and the like: null and empty texts, and those of white space only, have no n-grams, link with nothing and are
their own component; a text of fewer words is one n-gram of all its words.  Rows with a null doc_id take part, and a component of only such
rows has a null id.  Rows that share an id are rows of their own, each linked by its own text.  Very long texts are sets like any other and stand
in groups of their own.  An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, long_id, mixed, stored
from .simhash import components

#: Slices in which cell counts travel.
SLICES = 64
KEYS = ("doc_id long, key binary, n int, alike long, prefix array<long>, blob binary")


def factors(k: int) -> np.ndarray:
    """k odd multipliers, one for each place of an n-gram."""
    return mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def token_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as ascending 64-bit hashes; fewer than `width` words are one n-gram of them all."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat = words.flatten()
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # a text without words gives one empty word
    counts[counts == 1] = np.where(some[(np.cumsum(counts) - 1)[counts == 1]], 1, 0) if len(some) else 0
    coded = flat.filter(pa.array(some)).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    f = factors(width)
    full = np.full(max(0, len(h) - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if len(full) else 0):
            full += h[k : k + len(full)] * f[k]
    full, out, at = mixed(full), [], 0
    for n in counts.tolist():
        if n >= width:
            grams = np.sort(full[at : at + n - width + 1])
            out.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])])
        else:
            with np.errstate(over="ignore"):
                out.append(mixed(np.array([np.uint64(n) + (h[at : at + n] * f[:n]).sum(dtype=np.uint64)])) if n else h[:0])
        at += n
    return out


def cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - (cells - 1).bit_length())).astype(np.int64)


def frequencies(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """For every cell a byte that grows with the logarithm of how many rows' n-grams fall there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, some = np.zeros(cells, np.uint32), False
        for batch in in_slices(batches, "text", 4 << 20):
            for h in token_sets(batch.column("text"), width):
                np.add.at(n, cell_of(h, cells), 1)
                some = True
        if some:
            squeeze = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([squeeze.compress(x.tobytes()) for x in np.split(n, SLICES)])], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come slice by slice, so one slice's sums are held at a time."""
        expand, own, total = zstandard.ZstdDecompressor(), None, np.zeros(cells // SLICES, np.uint64)

        def level() -> pa.RecordBatch:
            levels = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([levels], pa.binary())], names=["slice", "levels"])

        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                if k != own:
                    if own is not None:
                        yield level()
                    own, total = k, np.zeros_like(total)
                total += np.frombuffer(expand.decompress(blob), np.uint32)
        if own is not None:
            yield level()

    found = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, levels binary").toArrow()
    out = np.zeros((SLICES, cells // SLICES), np.uint8)
    for k, levels in zip(found.column("slice").to_pylist(), found.column("levels").to_pylist()):
        out[k] = np.frombuffer(levels, np.uint8)
    return out.reshape(-1)


def needed(n, m, least: tuple[int, int]):
    """The overlap from which on sets of n and m have the similarity: ceil(least * (n + m) / (1 + least))."""
    return -(-least[0] * (n + m) // (least[0] + least[1]))


def signed(docs: DataFrame, levels: np.ndarray, width: int, least: tuple[int, int]) -> DataFrame:
    """Of every row its id, its set's key, size, min-hashes as one number and probe prefix, and its text, compressed."""
    shared, cells = docs.sparkSession.sparkContext.broadcast(levels), len(levels)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in in_slices(batches, "text", 4 << 20):
            keys, sizes, alike, firsts = [], [], [], []
            for h in token_sets(batch.column("text"), width):
                n = len(h)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if n else None)
                sizes.append(n)
                alike.append(xxhash.xxh64_intdigest(np.stack([h[:1], mixed(~h).min(initial=2**64 - 1, keepdims=True)]).tobytes()) if n else 0)
                order = np.argsort(shared.value[cell_of(h, cells)], kind="stable")
                firsts.append(h[order[: n - -(-least[0] * n // least[1]) + 1]].view(np.int64) if n else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            blobs = [squeeze.compress(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(alike, np.uint64).view(np.int64)), lists, pa.array(blobs, pa.binary())], names=["doc_id", "key", "n", "alike", "prefix", "blob"])

    return docs.mapInArrow(sign, KEYS)


def texts_of(ids: DataFrame, nodes: DataFrame, rows: DataFrame, small: int) -> DataFrame:
    """(id, blob: the text, compressed) of some nodes."""
    keys = stored(nodes.join(ids, "id", "left_semi").select("id", "key"))
    keys = F.broadcast(keys) if keys.count() <= small else keys
    return stored(rows.join(keys, "key").groupBy("id").agg(F.first("blob").alias("blob")))


def sets_of(blobs: list[bytes], width: int) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    return token_sets(pa.array([expand.decompress(b) for b in blobs], pa.binary()).cast(pa.string()), width)


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes that have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "x", 1 << 20):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            blobs = dict(zip(a, x)) | dict(zip(b, y))
            sets = dict(zip(blobs, sets_of(list(blobs.values()), width)))
            alike = [within(sets[i], sets[j]).sum() >= needed(len(sets[i]), len(sets[j]), least) for i, j in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("blob").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("blob").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """For each value, whether it is among the ascending ones."""
    at = np.searchsorted(ascending, values)
    return ascending[np.minimum(at, len(ascending) - 1)] == values


class Group:
    """Members with their components and texts, and the union of their n-grams; texts become sets when first asked for."""

    def __init__(self, width: int, ids: list[int], roots: list[int], sizes: list[int], blobs: list[bytes], union: bytes = b""):
        self.width, self.ids, self.roots, self.sizes, self.blobs = width, ids, roots, np.array(sizes, np.int64), blobs
        self.union = np.frombuffer(union, np.uint32)

    @cached_property
    def sets(self) -> list[np.ndarray]:
        return sets_of(self.blobs, self.width)

    def links(self, other: Group, least: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """Links between members here and there; one is enough for two components."""
        low = np.maximum(other.sizes.min(), -(-least[0] * self.sizes // least[1]))
        fits = (other.sizes.min() * least[0] <= self.sizes * least[1]) & (low <= other.sizes.max())
        same: dict[int, int] = {}

        def top(r: int) -> int:
            while r in same:
                r = same[r]
            return r

        for i in np.flatnonzero(fits).tolist():
            own, n = self.sets[i], int(self.sizes[i])
            if within(short(own), other.union).sum() < needed(n, int(low[i]), least):
                continue
            for j in np.flatnonzero(least[1] * np.minimum(n, other.sizes) >= least[0] * np.maximum(n, other.sizes)).tolist():
                if top(other.roots[j]) != top(self.roots[i]) and within(other.sets[j], own).sum() >= needed(n, int(other.sizes[j]), least):
                    same[top(other.roots[j])] = top(self.roots[i])
                    yield self.ids[i], other.ids[j]


def grouped(nodes: DataFrame, members: int, tokens: int) -> DataFrame:
    """nodes (id, n, root, alike) with `gid`: a component's, or else those of equal min-hashes, in parts of about
    `members` nodes and `tokens` n-grams."""
    size = nodes.groupBy("alike").agg(F.ceil(F.greatest(F.count("*") / members, F.sum(F.col("n").cast("long")) / tokens)).alias("parts"))
    return nodes.join(size, "alike").select("id", "n", "root", F.xxhash64("alike", F.pmod(F.xxhash64("id"), "parts")).alias("gid"))


def short(h: np.ndarray) -> np.ndarray:
    """The upper halves of hashes: a union of these is as good a bound and half as large."""
    return (h >> np.uint64(32)).astype(np.uint32)


def matrix(groups: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(gid, ids, roots, sizes, blobs, union) of every group (id, n, root, gid)."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unions = [np.unique(short(np.concatenate(sets_of(blobs, width)))).tobytes() for blobs in batch.column("blobs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unions, pa.binary())], names=[*batch.schema.names, "union"])

    rows = groups.join(texts, "id").groupBy("gid").agg(F.collect_list(F.struct("id", "root", "n", "blob")).alias("all"))
    rows = rows.select("gid", F.col("all.id").alias("ids"), F.col("all.root").alias("roots"), F.col("all.n").alias("sizes"), F.col("all.blob").alias("blobs"))
    return stored(rows.mapInArrow(unite, "gid long, ids array<long>, roots array<long>, sizes array<int>, blobs array<binary>, union binary"))


def group_pairs(open_: DataFrame, groups: DataFrame, indexed, least: tuple[int, int]) -> DataFrame:
    """(a, b) of groups that share an n-gram of a probe prefix there and an index prefix here, in sizes that fit, and aren't of
    one component only."""
    rows = open_.join(groups.select("id", "gid"), "id")
    sides, room = [], F.col("n") - F.col("at")  # the n-gram and those after it, which a pair's overlap can't exceed
    for s, own in (("a", rows), ("b", rows.where(indexed))):
        facts = {"low": F.min("n"), "high": F.max("n"), "room": F.max(room), "first": F.min("root"), "last": F.max("root")}
        sides.append(own.groupBy("token", F.col("gid").alias(s)).agg(*[f.alias(f"{c}_{s}") for c, f in facts.items()]))
    fits = (F.col("low_b") <= F.col("high_a")) & (F.col("high_b") * least[1] >= F.col("low_a") * least[0])
    apart = F.least("first_a", "first_b") != F.greatest("last_a", "last_b")
    enough = F.least("room_a", "room_b").cast("long") * (least[0] + least[1]) >= (F.col("low_a") + F.col("low_b")).cast("long") * least[0]
    return sides[0].join(sides[1], "token").where(fits & enough & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_links(pairs: DataFrame, groups: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): links of nodes between each pair of groups."""
    fields = {"a": ("ids", "roots", "sizes", "blobs"), "b": ("ids", "roots", "sizes", "blobs", "union")}  # here, there

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                left, right = (Group(width, *[batch.column(f"{c}_{s}")[k].as_py() for c in fields[s]]) for s in "ab")
                found += left.links(right, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    rows = pairs
    for s in "ab":
        rows = rows.join(groups.select(F.col("gid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in fields[s]]), s)
    return rows.select(*[f"{c}_{s}" for s in "ab" for c in fields[s]]).mapInArrow(compare, "a long, b long")


def joined(docs: DataFrame, width: int = 3, least: tuple[int, int] = (90, 100), cells: int = 1 << 24, members: int = 64, tokens: int = 1 << 18, small: int = 250_000) -> DataFrame:
    """(doc_id, n_shingles, component_id: the least doc_id that links reach) of every row; least is a fraction."""
    rows = docs.select(long_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(signed(rows, frequencies(rows, width, cells), width, least))
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("alike").alias("alike"), F.first("prefix").alias("prefix"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))
    whole = lambda a, b: F.call_function("div", a + F.lit(b - 1), F.lit(b).cast("long"))  # noqa: E731  ceil(a / b)
    least_overlap = lambda n, m: whole((n + m).cast("long") * least[0], least[0] + least[1])
    indexed = F.col("at") <= F.col("n") - least_overlap(F.col("n"), F.col("n"))

    prefix = nodes.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    hub = F.min(F.when(indexed, F.struct("id", "n", "at"))).alias("hub")
    shared = prefix.groupBy("token").agg(F.count("*").alias("many"), hub).where("many > 1 AND hub IS NOT NULL")
    met = stored(prefix.join(shared, "token"))
    sizes_fit = F.least("n", "hub.n") * least[1] >= F.greatest("n", "hub.n") * least[0]
    rest = F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))  # this n-gram and those after it
    tried = met.where((F.col("id") != F.col("hub.id")) & sizes_fit & (rest >= least_overlap(F.col("n"), F.col("hub.n"))))
    tried = stored(tried.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct())
    texts = texts_of(tried.select(F.explode(F.array("a", "b")).alias("id")).distinct(), nodes, rows, small)
    links = stored(similar(tried, texts, width, least))
    reached = stored(components(links))

    named = met.where("many > 2").join(reached, F.col("id") == F.col("node"), "left").select("token", "id", "n", "at", F.coalesce("root", "id").alias("root"), F.col("node").isNotNull().alias("linked"))
    mixed_tokens = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    open_ = stored(named.join(mixed_tokens, "token", "left_semi"))
    alike = F.when(F.col("linked"), F.xxhash64("root")).otherwise(F.col("alike")).alias("alike")
    members_of = open_.select("id", "n", "root", "linked").distinct().join(nodes.select("id", "alike"), "id").select("id", "n", "root", alike)
    groups = stored(grouped(members_of, members, tokens))
    meeting = stored(group_pairs(open_, groups, indexed, least))
    groups = stored(groups.join(meeting.select(F.explode(F.array("a", "b")).alias("gid")).distinct(), "gid", "left_semi"))
    more = group_links(meeting, matrix(groups, texts_of(groups.select("id"), nodes, rows, small), width), width, least)
    reached = stored(components(stored(links.union(more))))

    classes = nodes.select("id", "key", "first").join(reached, F.col("id") == F.col("node"), "left").select("key", "first", F.coalesce("root", "id").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(ids, "root").select("key", "component_id", F.lit(True).alias("known"))
    found = rows.select("doc_id", "key", "n").join(named, "key", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
