"""Exact repeated-window removal by super-k-mer partitioning.

A window is `width` consecutive words.  Its minimiser is the least scrambled hash of its `gram`-word grams.  Consecutive
windows that share a minimiser travel together as one packed string (a super-k-mer) to the minimiser's bucket.  There the
windows of all distinct strings are sorted, equal windows (compared word by word) meet, and each learns the smallest
doc_id in which it starts.

A minimiser that occurs in one document only can't hold a repeated window.  A first pass counts the minimisers; those of
several documents are set in a bitmap, which is broadcast; it has about an eighth of the texts' bytes in bits, at most
2**31 (256 MB).  Bits that collide let needless super-k-mers through and change no result.

Hot passages: equal super-k-mers of a task are one row before the shuffle, so a passage in a third of all documents is one
row for each task; the result goes back to the documents by the string's hash, in a join that splits skewed keys.
A bucket of more than `hot_rows` super-k-mers never meets whole: its distinct strings are dealt by their own hash to parts of
about `part_rows`.  A part sends the 128-bit XXH3 of each distinct window once, whose smallest doc_id is aggregated by hash;
only where it is smaller than the part's own does it come back to the part.

Nulls and ties: a null text has no words; rows of a null doc_id count as one document, smaller than all others; rows that
repeat a doc_id are one document and don't remove each other's words; a document of fewer than `width` words keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, long_id, mixed, stored

NO_ID = -(2**63)


class WordHashes(dict):
    """XXH64 of each word, kept while a batch of documents lasts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each `width` consecutive hashes, doubling the length step by step."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out, done, part, size, power = None, 0, hashes, 1, np.uint64(base)
        while size <= width:
            if width & size:
                out = part if out is None else out[: len(out) - size] * power + part[done : done + len(out) - size] if len(out) > size else out[:0]
                done += size
            if 2 * size > width:
                break
            part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power
    return out[:n]


def minimisers(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The minimiser of each window."""
    return sliding_min(mixed(rolling(hashes, gram, 0x9E3779B97F4A7C15)), width - gram + 1)


def bit_of(minimiser: np.ndarray, filter_bits: int) -> np.ndarray:
    """The bitmap's bit for each minimiser.  Minimisers are small numbers by their nature, so they are scrambled again."""
    return (mixed(minimiser ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - filter_bits)).astype(np.int64)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, then the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def shared_minimisers(docs: DataFrame, width: int, gram: int, filter_bits: int) -> np.ndarray:
    """A bitmap of 2**filter_bits bits, set for the minimisers that occur in several documents."""
    part_bits = max(0, filter_bits - 20)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            known, found, owner = WordHashes(), [], []
            for i, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text"))):
                words = text.split()
                if len(words) >= width:
                    m = minimisers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), width, gram)
                    m = np.sort(m)
                    m = m[runs_of(m)[:-1]]
                    found.append(m)
                    owner.append(np.full(len(m), i, np.int64))
            if found:
                bit = bit_of(np.concatenate(found), filter_bits)
                owner = np.concatenate(owner)
                order = np.argsort(bit, kind="stable")
                bit, owner = bit[order], owner[order]
                at = runs_of(bit)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(bit[at]), pa.array(np.minimum.reduceat(owner, at)), pa.array(np.maximum.reduceat(owner, at))], names=["bit", "low", "high"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            part = bit >> (filter_bits - part_bits)
            for p in np.unique(part).tolist():
                own = bits.setdefault(p, np.zeros(1 << (filter_bits - part_bits), bool))
                own[bit[part == p] & ((1 << (filter_bits - part_bits)) - 1)] = True
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(b).tobytes() for b in bits.values()])], names=["part", "bits"])

    rows = docs.mapInArrow(emit, "bit long, low long, high long")
    several = rows.groupBy("bit").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("bit")
    packed = several.repartition(F.shiftright("bit", filter_bits - part_bits)).mapInArrow(pack, "part long, bits binary")
    bitmap = np.zeros((1 << part_bits, (1 << (filter_bits - part_bits)) // 8), np.uint8)
    for row in packed.collect():  # as many parts as the bitmap has, at any size of the corpus
        bitmap[row.part] |= np.frombuffer(row.bits, np.uint8)
    return bitmap.ravel()


def super_kmers(docs: DataFrame, width: int, gram: int, filter_bits: int) -> DataFrame:
    """(id, row, pos: first word, n: windows, bucket: minimiser, packed: the words, joined by a space) where the bitmap has the minimiser."""
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_minimisers(docs, width, gram, filter_bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in in_slices(batches, "text", 4 << 20):
            known = WordHashes()
            ids, row, pos, n, bucket, packed = [], [], [], [], [], []
            for i, r, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), as_bytes(batch.column("text"))):
                words = text.split()
                if len(words) < width:
                    continue
                m = minimisers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), width, gram)
                cuts = runs_of(m)
                bit = bit_of(m[cuts[:-1]], filter_bits)
                for k in np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).tolist():
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    ids.append(i)
                    row.append(r)
                    pos.append(a)
                    n.append(b - a)
                    bucket.append(m[a])
                    packed.append(b" ".join(words[a : b + width - 1]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(bucket, np.uint64).view(np.int64)), pa.array(packed, pa.binary())], names=["id", "row", "pos", "n", "bucket", "packed"])

    return docs.mapInArrow(emit, "id long, row long, pos int, n int, bucket long, packed binary")


def first_owners(rows: list[tuple[bytes, int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the super-k-mers (packed, least id, windows) of one or more whole buckets: each window's smallest id, and the cuts between strings.

    Windows are sorted by a 64-bit hash; neighbours in that order are compared word by word, and windows whose words differ
    under one hash are told apart by their bytes.
    """
    known = WordHashes()
    words = [p.split() for p, _, _ in rows]
    number: dict[bytes, int] = {}
    flat = np.concatenate([np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words])
    table = np.fromiter((known[w] for w in number), np.uint64, len(number))
    sizes = np.array([len(w) for w in words])
    counts = sizes - width + 1
    cuts = np.concatenate([[0], np.cumsum(counts)])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.repeat(begins - cuts[:-1], counts) + np.arange(cuts[-1])  # first word of each window in flat
    owner = np.repeat(np.array([i for _, i, _ in rows], np.int64), counts)
    h = mixed(rolling(table[flat], width, 0xC2B2AE3D27D4EB4F))[at]
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    for a in range(1, len(order), 1 << 15):  # equal hashes: are the words equal too?
        k = np.flatnonzero(same[a : a + (1 << 15)]) + a
        if len(k):
            steps = np.arange(width)
            equal = (flat[at[order[k]][:, None] + steps] == flat[at[order[k - 1]][:, None] + steps]).all(axis=1)
            if not equal.all():  # a collision: sort these few windows by their words
                return by_words(flat, at, owner, width), cuts
    starts = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[order], starts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff([*starts, len(order)]))
    return out, cuts


def by_words(flat: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    least: dict[bytes, int] = {}
    keys = [flat[a : a + width].tobytes() for a in at.tolist()]
    for key, i in zip(keys, owner.tolist()):
        least[key] = min(i, least.get(key, i))
    return np.array([least[key] for key in keys], np.int64)


def as_answers(rows: Iterator[tuple[bytes, np.ndarray, int]]) -> pa.RecordBatch:
    """Of each (string, smallest id of each window, the largest id that holds the string) the runs of windows with one smallest id."""
    strings, starts, firsts = [], [], []
    for string, own, most in rows:
        if own.min() < most:  # else no document loses these windows
            at = runs_of(own)
            strings.append(string)
            starts.append(at[:-1].astype(np.int32))
            firsts.append(own[at[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int64()))], names=["string", "starts", "firsts"])


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[bytes, bytes, int, int]], dict[bytes, int]]]:
    """(bucket, part), its strings (string, packed, least, most), and the smaller ids (hash: id) that other parts have for its windows."""
    key, strings, first = None, [], {}
    for batch in batches:
        for bucket, part, string, packed, least, most, h in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "string", "packed", "least", "most", "h"))):
            if (bucket, part) != key:
                if key:
                    yield key, strings, first
                key, strings, first = (bucket, part), [], {}
            if h is None:
                strings.append((string, packed, least, most))
            else:
                first[h] = least
    if key:
        yield key, strings, first


def bits_for(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(31, max(20, int(size // 8).bit_length()))


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what names a row: its id, and its text's hash for rows that share an id."""
    text = F.col("text").cast("string")
    return docs.select(long_id().alias("doc_id"), text.alias("text"), F.coalesce(long_id(), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"))


def covered_spans(docs: DataFrame, width: int = 50, gram: int = 8, filter_bits: int | None = None, combine_bytes: int = 48 << 20, hot_rows: int = 256, part_rows: int = 512) -> DataFrame:
    """(id, row, spans: arrays of word positions [a, b), which may overlap) of the documents that lose words."""
    rows = with_keys(docs).select("id", "row", "text")
    filter_bits = filter_bits or bits_for(rows)
    found = stored(super_kmers(rows, width, gram, filter_bits).withColumn("string", F.md5("packed")).withColumn("string", F.unhex("string")))
    hot = stored(found.groupBy("bucket").count().where(F.col("count") > hot_rows).select("bucket"))
    strings = found.select("bucket", "string", "packed", "id")
    fields = "bucket long, string binary, packed binary, least long, most long"

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal strings of a task become one row, before the shuffle; what is held is bounded by `combine_bytes`."""
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for bucket, string, packed, i in zip(*(batch.column(c).to_pylist() for c in ("bucket", "string", "packed", "id"))):
                own = held.get(string)
                if own is None:
                    held[string] = [bucket, string, packed, i, i]
                    size += len(packed) + 200
                    if size > combine_bytes:
                        yield as_batch(list(held.values()))
                        held, size = {}, 0
                else:
                    own[3], own[4] = min(own[3], i), max(own[4], i)
        if held:
            yield as_batch(list(held.values()))

    def as_batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "string", "packed", "least", "most"])

    def hashes(packed: bytes) -> list[bytes]:
        """The hash of every window."""
        ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 32).tolist()
        starts = [0, *(e + 1 for e in ends)]
        return [xxhash.xxh3_128_digest(packed[starts[w] : ends[w + width - 1]]) for w in range(len(ends) - width + 1)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, part, string, w, h, least) of every distinct window of a part: where it stands first, its hash and its least id."""
        for key, strings, _ in parts_of(batches):
            held: dict[bytes, list] = {}
            for string, packed, least, _ in strings:
                for w, h in enumerate(hashes(packed)):
                    own = held.setdefault(h, [*key, string, w, h, least])
                    own[5] = min(own[5], least)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held.values()), kinds)], names=["bucket", "part", "string", "w", "h", "least"])

    def resolve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers for a part's strings, from the part itself and from what smaller ids other parts have."""
        for _, rows, first in parts_of(batches):
            known = [hashes(packed) for _, packed, _, _ in rows]
            for (_, _, least, _), own in zip(rows, known):
                for h in own:
                    first[h] = min(least, first.get(h, least))
            yield as_answers((string, np.array([first[h] for h in own], np.int64), most) for (string, _, _, most), own in zip(rows, known))

    distinct = strings.join(hot, "bucket", "left_anti").mapInArrow(combine, fields)
    combined = strings.join(hot, "bucket", "left_semi").mapInArrow(combine, fields)
    spread = stored(combined.groupBy("string").agg(F.first("bucket").alias("bucket"), F.first("packed").alias("packed"), F.min("least").alias("least"), F.max("most").alias("most")))
    sizes = spread.groupBy("bucket").agg(F.ceil(F.count("*") / part_rows).alias("n_parts"))
    dealt = spread.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("string"), "n_parts").cast("int").alias("part"), "string", "packed", "least", "most", F.lit(None).cast("binary").alias("h"))
    by_part = lambda rows: rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    apart = stored(by_part(dealt).mapInArrow(windows, "bucket long, part int, string binary, w int, h binary, least long"))
    firsts = apart.groupBy("h").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("h", "first")
    elsewhere = apart.join(firsts, "h").where("least > first").select("bucket", "part", F.lit(None).cast("binary").alias("string"), F.lit(None).cast("binary").alias("packed"), F.col("first").alias("least"), F.lit(None).cast("long").alias("most"), "h")
    apart_answers = by_part(dealt.union(elsewhere)).mapInArrow(resolve_parts, "string binary, starts array<int>, firsts array<long>")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []

        def answer(rows) -> pa.RecordBatch:
            owners, cuts = first_owners([(p, least, 0) for _, p, _, least, _ in rows], width)
            return as_answers((string, owners[a:b], most) for (_, _, string, _, most), a, b in zip(rows, cuts.tolist(), cuts[1:].tolist()))

        size = 0
        for batch in in_slices(batches, "packed", 1 << 20):
            for bucket, packed, string, least, most in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed", "string", "least", "most"))):
                if held and held[-1][2] == string:  # the same string of another task
                    held[-1] = (bucket, packed, string, min(least, held[-1][3]), max(most, held[-1][4]))
                    continue
                if size > 4 << 20 and held[-1][0] != bucket:
                    yield answer(held)
                    held, size = [], 0
                held.append((bucket, packed, string, least, most))
                size += len(packed)
        if held:
            yield answer(held)

    answers = distinct.repartition("bucket").sortWithinPartitions("bucket", "string").mapInArrow(resolve, "string binary, starts array<int>, firsts array<long>").union(apart_answers)
    uses = found.select("id", "row", "pos", "n", "string").join(answers, "string")
    runs = F.zip_with(F.col("starts"), F.concat(F.slice("starts", 2, F.size("starts")), F.array("n")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    lost = F.filter(F.zip_with(runs, F.col("firsts"), lambda r, first: F.when(first < F.col("id"), F.struct((F.col("pos") + r["a"]).alias("a"), (F.col("pos") + r["b"] + width - 1).alias("b")))), lambda r: r.isNotNull())
    parts = uses.select("id", "row", lost.alias("lost")).where(F.size("lost") > 0)
    return parts.groupBy("id", "row").agg(F.flatten(F.collect_list("lost")).alias("spans"))


def without_repeated_windows(docs: DataFrame, width: int = 50, gram: int = 8, filter_bits: int | None = None, hot_rows: int = 256) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the words that stay, joined by a space) of every row.

    The spans travel to the documents, whose texts are shuffled once, compressed.
    """
    spans = covered_spans(docs, width, gram, filter_bits, hot_rows=hot_rows)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in in_slices(batches, "text", 8 << 20):
            packed = pa.array([press.compress(t) for t in as_bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("row"), packed], names=["doc_id", "id", "row", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in in_slices(batches, "packed", 2 << 20):
            n_words, n_removed, kept = [], [], []
            for packed, own in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                words = open_.decompress(packed).split()
                n_words.append(len(words))
                if own:
                    stay = np.ones(len(words), bool)
                    for s in own:
                        stay[s["a"] : s["b"]] = False
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    texts = with_keys(docs).select("doc_id", "id", "row", "text").mapInArrow(squeeze, "doc_id long, id long, row long, packed binary")
    return texts.join(spans, ["id", "row"], "left").select("doc_id", "packed", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
