"""SentencePiece encoding and decoding of whole tables by suffix-array matching.

A batch's texts fall into segments that no piece can cross (before a space that follows another character, and around line
ends).  The batch's distinct segments are concatenated and indexed by a suffix array; every piece of the vocabulary is
binary-searched for its range of occurrences, which are the edges (start, end, piece).  The edges are sorted by position
and relaxed: the segments of a batch advance together, each taking in every round its mergeable edge of the best score
(the leftmost among equals), as the model's own encoder does.  Characters without a piece fall back to bytes.

Only models with identity normalisation, a dummy prefix, byte fallback and merge scores are taken; others raise an error.

Nulls: a null text encodes like an empty one, to no ids.  Rows are encoded one by one, repeated rows alike.
"""

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_slices, long_id

#: The default vocabulary file: one of the public tokenizers'.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
UNKNOWN = "\ufffd".encode()
#: Segments longer than this many bytes are merged one by one with a heap.
LONG = 256


class Vocabulary:
    """Pieces as bytes, with a space for the white-space mark."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            blob = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(blob)
        normal = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
            raise ValueError("this encoder takes merge models with identity normalisation, a dummy prefix and byte fallback")
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.byte_id = np.full(256, -1, np.int32)
        self.text_of: list[bytes] = []  # of each id; control pieces have none
        pieces: list[tuple[bytes, int, float]] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.text_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text_of.append(b"")
            else:
                text = piece.encode().replace(SPACE, b" ")
                if b"\n" in text or b" " in text.lstrip(b" "):
                    raise ValueError(f"piece {piece!r} crosses segments")
                self.text_of.append(text)
                pieces.append((text, i, sp.get_score(i)))
        pieces.sort()
        self.pieces = [p for p, _, _ in pieces]
        self.ids = np.array([i for _, i, _ in pieces], np.int32)
        score = np.array([s for _, _, s in pieces])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)  # 0 is merged first; equal scores share a rank
        self.chars = np.array([len(p.decode()) for p in self.pieces])
        self.id_of = {p: (int(r), int(i)) for p, r, i in zip(self.pieces, self.rank, self.ids)}
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)
        self.bounds = np.array([bounds(p) for p in self.pieces], np.uint64)


SEGMENT = re.compile(rb" *[^ \n]+| +|\n")


def segments_of(text: bytes) -> list[bytes]:
    return SEGMENT.findall(b" " + text.replace(SPACE, b" ")) if text else []


def packed(flat: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Eight bytes from each place (or from the places `at`), big-endian; flat is padded by at least eight zeros."""
    n = len(flat) - 8
    if at is None:
        out = np.zeros(n, np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | flat[k : k + n].astype(np.uint64)
        return out
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | flat[at + k].astype(np.uint64)
    return out


def suffixes(flat: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places 0 .. n - 1 in the order of their next `depth` bytes at least, and their first eight bytes in that order."""
    key = packed(flat[: n + 8])
    order = np.argsort(key)
    first = key[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    for step in range(8, depth, 8):  # only places that are still tied are sorted again
        tied = ~new
        tied[:-1] |= tied[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        group = np.cumsum(new)[place]
        then = packed(flat, order[place] + step)
        by = np.lexsort((then, group))
        order[place] = order[place][by]
        then, group = then[by], group[by]
        new[place] = np.concatenate([[True], (then[1:] != then[:-1]) | (group[1:] != group[:-1])])
    return order, first


def bounds(piece: bytes) -> tuple[int, int]:
    return int.from_bytes(piece[:8].ljust(8, b"\0"), "big"), int.from_bytes(piece[:8].ljust(8, b"\xff"), "big")


def matches(vocabulary: Vocabulary, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (start, piece number), sorted by position: every occurrence of every piece."""
    order, first = suffixes(flat, n, int(vocabulary.sizes.max()))
    low, high = np.searchsorted(first, vocabulary.bounds[:, 0], "left"), np.searchsorted(first, vocabulary.bounds[:, 1], "right")
    for k in np.flatnonzero((vocabulary.sizes > 8) & (low < high)).tolist():
        piece, a, b = vocabulary.pieces[k], int(low[k]), int(high[k])
        for step in range(8, len(piece), 8):  # within equal first bytes, the next eight are in order
            then = packed(flat, order[a:b] + step)
            x, y = bounds(piece[step:])
            a, b = a + int(np.searchsorted(then, np.uint64(x), "left")), a + int(np.searchsorted(then, np.uint64(y), "right"))
            if a >= b:
                break
        low[k], high[k] = a, b
    counts = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(low)), counts)
    start = order[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    edges = np.sort(start << 24 | piece)
    return (edges >> 24).astype(np.int32), (edges & 0xFFFFFF).astype(np.int32)


def by_heap(vocabulary: Vocabulary, text: bytes) -> list[int]:
    """Ids of one segment: best score first, leftmost among equals."""
    part: list[bytes | None] = [c.encode() for c in text.decode()]
    n = len(part)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (found := vocabulary.id_of.get(part[a] + part[b])):
            heapq.heappush(heap, (found[0], a, b, len(part[a]) + len(part[b])))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if part[a] is None or part[b] is None or after[a] != b or len(part[a]) + len(part[b]) != size:
            continue
        part[a] += part[b]
        part[b] = None
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    out: list[int] = []
    for p in part:
        if p is not None:
            found = vocabulary.id_of.get(p)
            out += [found[1]] if found else vocabulary.byte_id[list(p)].tolist()
    return out


def relaxed(vocabulary: Vocabulary, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segments in order, where each segment's ids begin, and the end)."""
    short = [s if len(s) <= LONG and s != b"\n" else b"" for s in segments]
    text = b"\n".join(short) + b"\n"
    n = len(text)
    flat = np.frombuffer(text + bytes(64), np.uint8)
    start, piece = matches(vocabulary, flat, n)
    size = vocabulary.sizes
    begins = (flat[: n + 1] & 0xC0) != 0x80  # symbols begin where characters do
    begins[n] = True
    token = np.full(n + 1, -1, np.int32)
    single = vocabulary.chars[piece] == 1
    token[start[single]] = vocabulary.ids[piece[single]]
    start, piece = start[~single], piece[~single]
    end = start + size[piece]
    segment = (np.cumsum(flat[:n] == 10) - (flat[:n] == 10)).astype(np.int32)
    places = np.flatnonzero(begins)
    after = np.zeros(n + 2, np.int32)
    after[places] = np.concatenate([places[1:], [n + 1]])
    rank, own = vocabulary.rank[piece].astype(np.int32), segment[start]
    while len(start):
        can = after[after[start]] == end
        ready = np.flatnonzero(can)
        if not len(ready):
            break
        mine = own[ready]
        at = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        key = rank[ready].astype(np.int64) << 32 | np.arange(len(ready))  # the leftmost of equal ranks: edges are sorted by position
        best = ready[np.minimum.reduceat(key, at) & 0xFFFFFFFF]
        middle = after[start[best]]
        begins[middle] = False
        after[start[best]] = end[best]
        token[start[best]] = vocabulary.ids[piece[best]]
        busy = np.zeros(len(segments) + 1, bool)
        busy[own[best]] = True
        alive = np.flatnonzero(busy[own] & begins[start] & begins[end] & (after[start] < end))
        start, piece, end, rank, own = start[alive], piece[alive], end[alive], rank[alive], own[alive]
    # The ids: one for each symbol, or one for each of its bytes.
    line_end = flat[:n] == 10
    begins[:n][line_end] = False
    symbol = np.flatnonzero(begins[:n])
    width = np.where(token[symbol] >= 0, 1, after[symbol] - symbol)
    ids = np.repeat(token[symbol], width)
    lone = np.flatnonzero(ids < 0)
    place = np.repeat(symbol - np.cumsum(width) + width, width) + np.arange(width.sum())
    ids[lone] = vocabulary.byte_id[flat[place[lone]]]
    counts = np.bincount(segment[symbol], weights=width, minlength=len(segments)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    if any(len(s) > LONG or s == b"\n" for s in segments):
        parts = [vocabulary.byte_id[[10]] if s == b"\n" else np.array(by_heap(vocabulary, s), np.int32) if len(s) > LONG else ids[a:b] for s, a, b in zip(segments, cuts.tolist(), cuts[1:].tolist())]
        ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids, cuts


class Encoder:
    """Encodes batches of texts; segments met before, up to `keep` of them, aren't matched again."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        self.vocabulary, self.keep = vocabulary, keep
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin, and the end)."""
        if len(self.number) > self.keep:
            self.forget()
        known = len(self.number)
        number, flat, sizes = self.number, [], []
        for text in texts:
            own = segments_of(text)
            sizes.append(len(own))
            flat += own
        for s in set(flat):
            number.setdefault(s, len(number))
        if len(number) > known:
            ids, cuts = relaxed(self.vocabulary, list(number)[known:])
            self.ids, self.cuts = np.concatenate([self.ids, ids]), np.concatenate([self.cuts, self.cuts[-1] + cuts[1:]])
        used = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        begin, counts = self.cuts[used], self.cuts[used + 1] - self.cuts[used]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = self.ids[np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])]
        return out, ends[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]


def decode(vocabulary: Vocabulary, ids: list[int | None]) -> bytes:
    """The text of ids, without the dummy prefix; ids that no piece has, and nulls, give U+FFFD."""
    known = vocabulary.text_of
    text = b"".join(known[i] if i is not None and 0 <= i < len(known) else UNKNOWN for i in ids)
    return text[1:] if text[:1] == b" " else text


def encoded(docs: DataFrame, model_file: str = MODEL, batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip: do the ids decode to the text) of every row; no shuffle.

    A text that holds the model's white-space mark U+2581 comes back with spaces there, so its round_trip is false.

    The vocabulary, whose size is the model file's, is read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch in in_slices(batches, "text", batch_bytes):
            texts = as_bytes(batch.column("text"))
            ids, cuts = encoder.encode(texts)
            same = [decode(vocabulary, ids[a:b].tolist()) == t for t, a, b in zip(texts, cuts.tolist(), cuts[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(cuts), pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(long_id().alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decoded(rows: DataFrame, model_file: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """All columns of rows, and `text`, decoded from ids (bytes that are no UTF-8 become U+FFFD); null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode(shared.value, [None if i is None or i != i else int(i) for i in x]).decode("utf-8", "replace"))  # pandas makes nulls NaN

    return rows.withColumn("text", text_of(F.col(ids_col)))
