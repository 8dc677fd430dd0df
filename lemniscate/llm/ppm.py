"""Prediction by partial matching over bytes, and the smoothed word counts it is compared with.

A text is coded as its lower-cased words, joined by a space, and one line end; `order` line ends stand before it.  The model
is a trie of byte contexts of up to `order` bytes, which run through the whole text, across words.  A byte that a context
has seen n times has (2n - 1) / 2T there, T being the sum over its symbols; else the context escapes with D / 2T, D being
its number of symbols, to the context one byte shorter (escape method D), where the symbols of the longer one are excluded
from all counts; below order 0 the bytes not yet excluded are equally likely.  The longest contexts count every occurrence;
a shorter one counts a symbol once for each context one byte longer in which it was seen (update exclusion).

Above the trie stand the document's own nodes, which adapt as its text goes by: a context of three bytes, then one of seven
(`OWN_NODES`).  One that was met t times, n of them before this byte, gives (n + weight * p) / (t + weight), p being what it
escapes to.  They start anew with each document, and in a long one every 2**18 bytes.  A document's score is the log10
probability of all its bytes.

Statistics travel in packs, never byte by byte.  Documents are packed into chunks of about `chunk_bytes`; a chunk asks for
its distinct grams (a context and a symbol) in sorted, delta-coded lists, one for each bucket.  The last three bytes of a
context choose the bucket, so all its contexts of three bytes and more are there.  Each bucket merges the chunks' counts
into its part of the trie, answers the lists with log probabilities, and these go back to the chunks.  Words are counted in
the same way, by XXH64.  There are as many buckets as `bucket_bytes` of text ask for, 4,096 at most; beyond, a bucket's
lists are dealt to several tasks, each with a copy of the bucket's part.  That part grows with the distinct grams of the
corpus only; of one three-byte suffix there are at most 2**(8 * (order - 2)).  Contexts of two bytes and less are one
array of 2**24 counts (32 MB at any size), which is broadcast.

Nulls and ties: a null text is an empty one, whose only token is its end; a row whose `held_out` is null is learned from;
repeated rows count each time; ids are text, numbers or null; with nothing to learn from, all bytes are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, mixed, stored

#: The end of a text, as a word and as a byte.
END, END_BYTE = b"", b"\n"
TEXTS, GRAMS, WORDS = range(3)
#: Positions that are turned into grams at once.
AT_ONCE = 1 << 18
#: (bytes of context, weight of the escape) of a document's own nodes, from the lower one.
OWN_NODES = ((3, 64.0), (7, 4.0))


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def u64(x: int) -> np.uint64:
    return np.uint64(x)


class Stream:
    """Coded texts one behind the other, each after its line ends; grams are read off in slices.

    A slice holds whole texts, or a part of `AT_ONCE` bytes of a longer one.
    """

    def __init__(self, lines: list[bytes], order: int):
        self.order = order
        self.flat = np.frombuffer(b"".join(END_BYTE * order + line + END_BYTE for line in lines), np.uint8)
        sizes = np.array([len(line) + 1 for line in lines], np.int64)
        starts = np.cumsum(sizes + order) - sizes - order
        self.coded = np.ones(len(self.flat), bool)
        self.coded[(starts[:, None] + np.arange(order)).ravel()] = False
        self.doc = np.repeat(np.arange(len(lines), dtype=np.int32), sizes + order)
        self.cuts, size = [0], 0
        for a, n in zip(starts.tolist(), sizes.tolist()):
            if size and size + n > AT_ONCE:
                self.cuts.append(a)
                size = 0
            for b in range(a + order + AT_ONCE, a + order + n, AT_ONCE):
                self.cuts.append(b)
                n -= AT_ONCE
            size += n
        self.cuts.append(len(self.flat))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(gram: the context's bytes and the symbol in one number, document) of every coded position."""
        for a, b in zip(self.cuts, self.cuts[1:]):
            first = max(0, a - self.order)
            own = self.flat[first:b].astype(np.uint64)
            code = own.copy()
            for k in range(1, self.order + 1):
                code[k:] |= own[:-k] << u64(8 * k)
            coded = self.coded[a:b]
            yield code[a - first :][coded], self.doc[a:b][coded]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    by = np.argsort(code, kind="stable")
    code, n = code[by], n[by]
    at = firsts(code)
    return code[at], np.add.reduceat(n, at) if len(at) else n


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[firsts(x)]


def distinct_grams(stream: Stream, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, ascending, and how often those of texts that aren't held out occur (none are counted without `held`)."""
    parts = []
    for code, doc in stream.grams():
        if held is None:
            parts.append((distinct(code), None))
        else:
            out = held[doc]
            parts.append(np.unique(code[~out], return_counts=True))
            parts.append((distinct(code[out]), None))
    return summed([(code, np.zeros(len(code), np.int64) if n is None else n) for code, n in parts])


def distinct_words(lines: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all words of the texts, ascending, and how often they occur in texts that aren't held out."""
    seen: dict[bytes, int] = {}
    for line, out in zip(lines, held.tolist()):
        for w in line.split():
            seen[w] = seen.get(w, 0) + (not out)
    seen[END] = int((~held).sum())
    h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
    n = np.fromiter(seen.values(), np.int64, len(seen))
    return summed([(h, n), (h[:0], n[:0])])


def buckets_of(kind: int, code: np.ndarray, bits: int) -> np.ndarray:
    """Grams go by the last three bytes of their context, words by their hash."""
    spread = mixed(code >> u64(8) & u64(0xFFFFFF)) if kind == GRAMS else code
    return (spread >> u64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(code), np.uint16)


def by_bucket(kind: int, code: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its codes, ascending)."""
    bucket = buckets_of(kind, code, bits)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    at = firsts(ordered)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
        yield int(ordered[a]), order[a:b]


def seen_before(code: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often each code of `bits` bits stood at earlier places of its document, places of codes that stand there more
    than once); AT_ONCE places at most."""
    place, n = u64(AT_ONCE.bit_length() - 1), len(code)
    doc = (doc - doc[:1]).astype(np.uint64)
    exact = bits + int(place) + int(doc.max(initial=0)).bit_length() <= 64
    whole = doc << u64(bits) | code if exact else mixed(code ^ mixed(doc + u64(1))) >> place
    key = np.sort(whole << place | np.arange(n, dtype=np.uint64))
    at = (key & u64(AT_ONCE - 1)).astype(np.int32)
    own = key >> place
    new = np.ones(n + 1, bool)
    new[1:-1] = own[1:] != own[:-1]
    if not exact:
        tied = np.flatnonzero(~new)
        a, b = at[tied - 1], at[tied]
        if ((code[a] != code[b]) | (doc[a] != doc[b])).any():  # hashes collide: sort by what they stand for
            at = np.lexsort((code, doc)).astype(np.int32)
            new[1:-1] = (code[at[1:]] != code[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    start = np.flatnonzero(new[:-1]).astype(np.int32)
    out = np.empty(n, np.int32)
    out[at] = np.arange(n, dtype=np.int32) - np.repeat(start, np.diff(start, append=np.int32(n)))
    return out, np.sort(at[~(new[:-1] & new[1:])])


def adapted(code: np.ndarray, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities once the document's own nodes have had their say: (seen + weight * p) / (met + weight) at each."""
    p = p.copy()
    for order, weight in OWN_NODES:
        gram = code & u64((1 << 8 * (order + 1)) - 1)
        met, shared = seen_before(gram >> u64(8), doc, 8 * order)
        p[shared] = (seen_before(gram[shared], doc[shared], 8 * (order + 1))[0] + weight * p[shared]) / (met[shared] + weight)
    return p


def looked_up(gram: np.ndarray, p: np.ndarray, code: np.ndarray) -> np.ndarray:
    """p at each code's place among the grams; codes of up to six bytes are sorted first, some at a time, which is faster."""
    if len(gram) and int(gram[-1]) >> 48:
        return p[np.searchsorted(gram, code)]
    out, size = np.empty(len(code)), 1 << 16
    for a in range(0, len(code), size):
        key = np.sort(code[a : a + size] << u64(16) | np.arange(min(size, len(code) - a), dtype=np.uint64))
        own = key >> u64(16)
        at = firsts(own)
        out[a + (key & u64(size - 1)).astype(np.int64)] = np.repeat(p[np.searchsorted(gram, own[at])], np.diff(at, append=len(own)))
    return out


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unsqueezed(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def codes_out(code: np.ndarray) -> bytes:
    return squeezed(np.diff(code, prepend=u64(0)))


def codes_in(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(blob, np.uint64), dtype=np.uint64)


PACKED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("codes", pa.binary()), ("counts", pa.binary())])


def packed_chunks(docs: DataFrame, order: int, bits: int, chunk_bytes: int) -> DataFrame:
    """(kind, chunk, bucket, ids, held, codes, counts): a row for each chunk's texts (compressed in codes), and one for
    each bucket of its distinct grams and of its distinct words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for k, batch in enumerate(in_slices(batches, "text", chunk_bytes)):
            chunk = (TaskContext.get().partitionId() << 32) + k
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            lines = [b" ".join(t.lower().split()) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([TEXTS], [chunk], [0], [batch.column("doc_id").to_pylist()], [held.tolist()], [squeeze.compress(END_BYTE.join(lines))], [None]), PACKED)], schema=PACKED)
            for kind, (code, n) in ((GRAMS, distinct_grams(Stream(lines, order), held)), (WORDS, distinct_words(lines, held))):
                rows = [(kind, chunk, bucket, None, None, codes_out(code[at]), squeezed(n[at])) for bucket, at in by_bucket(kind, code, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PACKED)], schema=PACKED)

    return docs.mapInArrow(pack, "kind int, chunk long, bucket int, ids array<string>, held array<boolean>, codes binary, counts binary")


def merged_counts(lists: DataFrame, *by: str) -> DataFrame:
    """(by, codes, counts, size: the sum of the counts, seen: how many codes have one); codes without a count are left out."""
    at = [*by]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, waiting = None, [], 0

        def row() -> pa.RecordBatch:
            code, n = summed(parts)
            code, n = code[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), pa.array([codes_out(code)]), pa.array([squeezed(n)]), pa.array([int(n.sum())]), pa.array([len(n)])], names=[*at, "codes", "counts", "size", "seen"])

        for batch in batches:
            for *own, codes, counts in zip(*(batch.column(c).to_pylist() for c in (*at, "codes", "counts"))):
                if own != key:
                    if parts:
                        yield row()
                    key, parts, waiting = own, [], 0
                parts.append((codes_in(codes), unsqueezed(counts, np.int64)))
                waiting += len(parts[-1][0])
                if waiting > max(1 << 20, 2 * len(parts[0][0])):  # what is held stays in proportion to the distinct codes
                    parts, waiting = [summed(parts)], 0
        if parts:
            yield row()

    rows = lists.select(*at, "codes", "counts").repartition(*at).sortWithinPartitions(*at)
    return rows.mapInArrow(merge, f"{', '.join(f'{c} int' for c in at)}, codes binary, counts binary, size long, seen long")


def low_counts(tables: DataFrame, order: int) -> np.ndarray:
    """How many contexts of three bytes bring each trigram: counts of contexts of two bytes, 2**24 of them.  They come to
    the driver as 4,096 pages at most."""

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("codes").to_pylist():
                four = codes_in(blob) & u64(0xFFFFFFFF)
                code, n = np.unique(distinct(four) & u64(0xFFFFFF), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n.astype(np.int32))], names=["code", "n"])

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            for p in np.unique(code >> 12).tolist():
                own = pages.setdefault(p, np.zeros(4096, np.uint16))
                np.add.at(own, code[code >> 12 == p] & 4095, n[code >> 12 == p].astype(np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], names=["page", "counts"])

    rows = tables.select("codes").mapInArrow(trigrams, "code int, n int").groupBy("code").agg(F.sum("n").cast("int").alias("n"))
    out = np.zeros((4096, 4096), np.uint16)
    for row in rows.repartition(F.shiftright("code", 12)).mapInArrow(page, "page int, counts binary").collect():
        out[row.page] += np.frombuffer(row.counts, np.uint16)
    return out.ravel()


class Nodes:
    """The trie's nodes of one order: grams and counts, ascending, and for each context its sum, its number of symbols, and
    what its symbols count in the next shorter context."""

    def __init__(self, code: np.ndarray, n: np.ndarray, lower: Nodes | None, order: int):
        self.code, self.n = code, n.astype(np.float64)
        at = firsts(code >> u64(8))
        self.context = code[at] >> u64(8)
        self.total = np.add.reduceat(self.n, at) if len(at) else np.zeros(0)
        self.distinct = np.diff([*at, len(code)]).astype(np.float64)
        if lower is None:
            self.below = np.zeros(len(at))
        else:
            self.below = np.add.reduceat(lower.n[np.searchsorted(lower.code, code & u64((1 << 8 * order) - 1))], at) if len(at) else np.zeros(0)


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each number in sorted keys."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Trie:
    """The orders from `order` down to 0 over the contexts of one bucket."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: list[Nodes], order: int):
        grams = [(code, n)]
        for k in range(order - 1, 2, -1):
            grams.append(np.unique(grams[-1][0] & u64((1 << 8 * (k + 1)) - 1), return_counts=True))
        self.orders = list(low)
        for k, (c, m) in zip(range(3, order + 1), grams[::-1]):
            self.orders.append(Nodes(c, m, self.orders[-1], k))

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        cut_n, cut_d = np.zeros(len(grams)), np.zeros(len(grams))  # what longer contexts exclude
        for k in range(len(self.orders) - 1, -1, -1):
            nodes = self.orders[k]
            own = grams[left] & u64((1 << 8 * (k + 1)) - 1)
            at, known = found(nodes.context, own >> u64(8))
            place, seen = found(nodes.code, own)
            if len(nodes.code):
                total = np.where(known, nodes.total[at] - cut_n, 0)
                escape = np.where(known, nodes.distinct[at] - cut_d, 0)
                over = 2 * np.maximum(total, 0.5)
                # A context whose symbols are all excluded escapes surely.
                out[left] += np.log10(np.where(seen, 2 * nodes.n[place] - 1, np.where(escape > 0, escape, over)) / over)
            left, known, at = left[~seen], known[~seen], at[~seen]
            if not len(left):
                return out
            if len(nodes.code):
                cut_n, cut_d = np.where(known, nodes.below[at], 0), np.where(known, nodes.distinct[at], 0)
            else:
                cut_n, cut_d = np.zeros(len(left)), np.zeros(len(left))
        out[left] -= np.log10(max(1, 256 - len(self.orders[0].code)))
        return out


def low_orders(counts: np.ndarray) -> list[Nodes]:
    """The nodes of order 0, 1 and 2."""
    two = np.flatnonzero(counts)
    one, n_one = np.unique(two & 0xFFFF, return_counts=True)
    zero, n_zero = np.unique(one & 0xFF, return_counts=True)
    out: list[Nodes] = []
    for k, (code, n) in enumerate(((zero, n_zero), (one, n_one), (two, counts[two]))):
        out.append(Nodes(code.astype(np.uint64), n, out[-1] if out else None, k))
    return out


def answers(lists: DataFrame, tables: DataFrame, low: np.ndarray, order: int, salts: int) -> DataFrame:
    """(chunk, kind, bucket, counts): the answers to a chunk's lists, log10 probabilities of grams or counts of words.

    A bucket's table and its lists come to one task, or to `salts` tasks, each with the table and a part of the lists.
    """
    shared = lists.sparkSession.sparkContext.broadcast(low)
    at = ["kind", "bucket", "salt", "is_list"]
    asked = lists.select("kind", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("is_list"), "chunk", "codes", F.lit(None).cast("binary").alias("counts"))
    known = tables.select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("is_list"), F.lit(0).cast("long").alias("chunk"), "codes", "counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, key, trie = low_orders(shared.value), None, None
        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for kind, bucket, salt, is_list, chunk, codes, counts in zip(*(batch.column(c).to_pylist() for c in (*at, "chunk", "codes", "counts"))):
                own = codes_in(codes)
                if key != (kind, bucket, salt):  # the table stands before the lists; without one, nothing was learned here
                    key = (kind, bucket, salt)
                    code, n = (own[:0], np.zeros(0, np.int64)) if is_list else (own, unsqueezed(counts, np.int64))
                    trie = Trie(code, n, lower, order) if kind == GRAMS else None
                if is_list and kind == GRAMS:
                    out.append((chunk, kind, bucket, squeezed(trie.log_p(own).astype(np.float32))))
                elif is_list:
                    place, there = found(code, own)
                    out.append((chunk, kind, bucket, squeezed(np.where(there, n[place], 0) if len(n) else np.zeros(len(own), np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "kind", "bucket", "counts"])

    rows = asked.union(known).repartition("kind", "bucket", "salt").sortWithinPartitions(*at)
    return rows.mapInArrow(answer, "chunk long, kind int, bucket int, counts binary")


def scores(docs: DataFrame, held_out: Column, order: int = 5, chunk_bytes: int = 12 << 20, bucket_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from rows that aren't held out."""
    if not 3 <= order <= 7:
        raise ValueError("a gram of 4 to 8 bytes is one number: order is 3 to 7")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(12, max(0, int(size // bucket_bytes).bit_length()))
    salts = 1 + int(size // ((16 * bucket_bytes) << bits))
    packs = stored(packed_chunks(rows, order, bits, chunk_bytes), "kind")
    lists = packs.where(F.col("kind") != TEXTS).select("kind", "chunk", "bucket", "codes", "counts")
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    tables = stored(merged_counts(merged_counts(salted, "kind", "bucket", "salt") if salts > 1 else salted, "kind", "bucket"))
    total = tables.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()
    train_tokens, divisor = int(total.n), float(np.log10(total.n + total.v + 1))
    answered = answers(lists, tables, low_counts(tables.where(F.col("kind") == GRAMS), order), order, salts)

    def gathered(kind: int, code: np.ndarray, own: dict[tuple[int, int], bytes], like: type) -> np.ndarray:
        out = np.zeros(len(code), like)
        for bucket, at in by_bucket(kind, code, bits):
            out[at] = unsqueezed(own[kind, bucket], like)
        return out

    def score(texts: pa.Table, found_: pa.Table) -> pa.Table:
        own = {(k, b): x for k, b, x in zip(*(found_.column(c).to_pylist() for c in ("kind", "bucket", "counts")))}
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for ids, held, blob in zip(*(texts.column(c).to_pylist() for c in ("ids", "held", "codes"))):
            lines = zstandard.ZstdDecompressor().decompress(blob).split(END_BYTE)
            number: dict[bytes, int] = {END: 0}
            token, sizes = [], []
            for line in lines:
                own_words = line.split()
                token += [number.setdefault(w, len(number)) for w in own_words]
                token.append(0)
                sizes.append(len(own_words) + 1)
            h = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            by = np.argsort(h)
            keep = firsts(h[by])
            c = np.empty(len(number), np.int64)
            c[by] = np.repeat(gathered(WORDS, h[by][keep], own, np.int64), np.diff(keep, append=len(by)))
            n, starts = c[np.array(token, np.int64)], np.cumsum(sizes) - sizes
            out["n_tokens"] += sizes
            out["n_known"] += np.add.reduceat((n > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(np.log10(n + 1) - divisor, starts).tolist()
            gram, _ = distinct_grams(Stream(lines, order), None)
            p, total = 10.0 ** gathered(GRAMS, gram, own, np.float32).astype(np.float64), np.zeros(len(lines))
            for code, doc in Stream(lines, max(order, *(k for k, _ in OWN_NODES))).grams():
                first = looked_up(gram, p, code & u64((1 << 8 * (order + 1)) - 1))
                total += np.bincount(doc, np.log10(adapted(code, doc, first)), len(lines))
            out["doc_id"] += ids
            out["held_out"] += held
            out["score"] += total.tolist()
        kinds = {"doc_id": pa.string(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        columns = {k: pa.array(v, kinds[k]) for k, v in out.items()} | {"train_tokens": pa.array([train_tokens] * len(out["doc_id"]), pa.int64())}
        return pa.table({k: columns[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    texts = packs.where(F.col("kind") == TEXTS).select(F.col("chunk").alias("own"), "ids", "held", "codes")
    done = texts.groupBy("own").cogroup(answered.groupBy("chunk")).applyInArrow(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(id_kind))


class PlainTrie:
    """The same model in plain form, for adaptive coding of single texts: every byte is coded, then learned."""

    def __init__(self, order: int = 5):
        self.order, self.nodes = order, {}

    def learn_at(self, text: bytes, i: int) -> None:
        """Count the byte in its longest context, and in each shorter one until one knew it."""
        for k in range(self.order, -1, -1):
            own = self.nodes.setdefault(text[i - k : i], {})
            own[text[i]] = own.get(text[i], 0) + 1
            if own[text[i]] > 1:
                return

    def learn(self, text: bytes) -> None:
        text = END_BYTE * self.order + text
        for i in range(self.order, len(text)):
            self.learn_at(text, i)

    def code_lengths(self, text: bytes, adapt: bool = True) -> Iterator[float]:
        """log10 probability of each byte of a text."""
        text = END_BYTE * self.order + text
        for i in range(self.order, len(text)):
            excluded: set[int] = set()
            p, symbol = 1.0, text[i]
            for k in range(self.order, -1, -1):
                node = {s: n for s, n in self.nodes.get(text[i - k : i], {}).items() if s not in excluded}
                if not node:
                    continue
                whole = 2 * sum(node.values())
                if symbol in node:
                    p *= (2 * node[symbol] - 1) / whole
                    break
                p *= len(node) / whole
                excluded |= set(node)
            else:
                p /= max(1, 256 - len(excluded))
            if adapt:
                self.learn_at(text, i)
            yield float(np.log10(p))


def adaptive_scores(docs: DataFrame, order: int = 5) -> DataFrame:
    """(doc_id, score: log10 probability of each text coded alone, the model learning as it goes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 1 << 20):
            coded = (b" ".join(t.lower().split()) + END_BYTE for t in as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sum(PlainTrie(order).code_lengths(t)) for t in coded], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
