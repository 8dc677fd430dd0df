"""Line, near and substring deduplication and decontamination against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lemniscate.llm import decontaminate, line_dedup, simhash, substring_dedup

from .helpers import awkward, clashing, lower, spaces, table


def lines_by_force(texts, ids, min_chars, min_docs):
    strip = lambda s: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", s))
    owners = {}
    for i, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            if len(strip(line)) >= min_chars:
                owners.setdefault(strip(line), set()).add(i)
    out = {}
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(owners.get(strip(s), ())) < min_docs or max(owners[strip(s)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (6, 3)])
def test_lines(spark, batches, fanout):
    texts = awkward()
    ids = [(7 * i) % 997 for i in range(len(texts))]
    got = line_dedup.without_repeated_lines(clashing(table(spark, texts, ids)), min_chars=10, min_docs=3, batches=batches, fanout=fanout).collect()
    want = lines_by_force(texts, ids, 10, 3)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got} == want
    assert sum(w[1] for w in want.values()) > 5


def test_lines_of_awkward_ids(spark):
    line = "a line that is long enough to count as one"
    docs = table(spark, [line] * 6 + ["other"], [None, None, 1, 2, 3, 3, None])
    got = line_dedup.without_repeated_lines(docs, min_docs=4).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    assert line_dedup.without_repeated_lines(table(spark, [])).count() == 0


def test_a_text_of_very_many_lines(spark):
    line = "a line that is long enough to count, number "
    long = "\n".join(f"{line}{i % 20_000}" if i % 2 else "short" for i in range(80_000))
    others = ["\n".join(f"{line}{i}" for i in range(1, 20_000, 2))] * 5
    rows = {r.doc_id: r for r in line_dedup.without_repeated_lines(table(spark, [long, *others, "x\n" + line + "1"], list(range(7)))).collect()}
    assert (rows[0].n_lines, rows[0].n_dropped) == (80_000, 40_000) and rows[0].text == "\n".join(["short"] * 40_000)
    assert rows[5].n_dropped == 1 and rows[6].n_dropped == 0 and rows[1].text == ""


def fingerprint_by_force(text, width=3):
    words = spaces(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(nodes, radius):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    texts = awkward()
    docs = clashing(table(spark, texts + ["lone"], [*range(5, 5 + len(texts)), None]))
    got = simhash.near_duplicates(docs).collect()
    fps = [fingerprint_by_force(t) for t in texts] + [fingerprint_by_force("lone")]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1)) for r in got) == sorted([*zip(range(5, 5 + len(texts)), fps), (-1, fps[-1])])
    group = groups_by_force(set(fps), 3)
    least = {}
    for i, f in zip(range(5, 5 + len(texts)), fps):
        least[group[f]] = min(i, least.get(group[f], i))
    assert all(r.component_id == least.get(group[r.fp & (2**64 - 1)]) for r in got)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("block_rows", [8, 64, 4096])
def test_links_within_blocks_and_across(spark, block_rows):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(40):  # clusters whose members share most bands, so blocks split
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(int(rng.integers(1, 12))):
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    for _ in range(150):
        fps.add((0xABCD << 48) | int(rng.integers(0, 2**20)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.near_links(nodes, 3, block_rows)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs) and len(pairs) <= 4 * len(fps)
    want = groups_by_force(fps, 3)
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(links).collect()}
    got = {f: roots.get(f, f) for f in fps}
    for a in fps:
        for b in fps:
            assert (want[a] == want[b]) == (got[a] == got[b])


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[101] == 100
    assert simhash.components(links.limit(0)).count() == 0


def windows_by_force(texts, ids, width):
    first = {}
    for i, t in zip(ids, texts):
        w = spaces(t)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in zip(ids, texts):
        w = spaces(t)
        gone = {p for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < i for p in range(a, a + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("width, gram, bits, hot_rows", [(5, 3, 20, 256), (8, 3, 24, 2), (14, 8, None, 256), (4, 4, 20, 0)])
def test_windows(spark, width, gram, bits, hot_rows):
    texts = awkward(seed=2)
    ids = [(11 * i) % 1009 for i in range(len(texts))]
    got = substring_dedup.without_repeated_windows(clashing(table(spark, texts, ids)), width, gram, bits, hot_rows).collect()
    want = windows_by_force(texts, ids, width)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(w[2] for w in want) > 50


def test_windows_of_awkward_ids(spark):
    text = " ".join(str(i) for i in range(20))
    got = substring_dedup.without_repeated_windows(table(spark, [text, text, text + " x", text, None], [4, 4, 9, None, 4]), 6, 3).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20, 0), (4, 0, 0), (4, 20, 20), (4, 20, 20), (9, 21, 20)]
    assert substring_dedup.without_repeated_windows(table(spark, []), 6, 3).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolling", lambda h, width, base: np.zeros(max(0, len(h) - width + 1), np.uint64))
    owners, cuts = substring_dedup.first_owners([(b"a b c", 5, 0), (b"b c d", 3, 0), (b"a b x", 1, 0)], 2)
    assert owners.tolist() == [1, 3, 3, 3, 1, 1] and cuts.tolist() == [0, 2, 4, 6]


def leaks_by_force(texts, items, width=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for i, t in items:
        w = find(t)
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(i))
    out = []
    for t in texts:
        w = find(t)
        hit, own = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    own |= windows[k]
        out.append((len(w), len(hit), sorted(own)))
    return out


@pytest.mark.parametrize("block_words, shard_bytes, at_once", [(200_000, 6 << 20, 16), (5, 500, 16), (5, 500, 2)])
def test_decontamination(spark, block_words, shard_bytes, at_once):
    texts = awkward(seed=4)
    items = [(1, "alpha beta"), (2, texts[20]), (3, texts[25]), (4, None), (5, "---"), (6, "zeta9!x"), (2, "日本 the"), (7, "no such words at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(clashing(table(spark, texts)), bench, 6, block_words, shard_bytes, at_once).orderBy("doc_id").collect()
    want = leaks_by_force(texts, items, 6)
    assert [(r.n_words, sum(s.b - s.a for s in r.spans), list(r.items)) for r in got] == want
    assert sum(w[1] > 0 for w in want) > 10


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "two Three four")], "item_id long, text string")
    docs = table(spark, ["One, (two) three-FOUR! five", "clean", None])
    got = {r.doc_id: r for r in decontaminate.decontaminated(docs, bench).collect()}
    assert got[0].text == "One, (! five" and got[1].text == "clean" and got[2].text is None and got[0].source == "src"
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == 3
    several = bench.union(spark.createDataFrame([(2, "five"), (3, "one")], "item_id int, text string"))
    rows = decontaminate.decontaminated(docs.withColumn("_spans", F.lit("own")), several, block_words=1, blocks_at_once=1).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["", "clean", None] and {r._spans for r in rows} == {"own"}


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 300):
        text = rng.integers(0, 4, n)
        sa = decontaminate.suffix_array(text)
        assert [tuple(text[i:]) for i in sa] == sorted(tuple(text[i:]) for i in range(n))
        wm = decontaminate.WaveletMatrix(text, 4)
        at = np.arange(n + 1)
        for c in range(4):
            assert wm.rank(np.full(n + 1, c), at).tolist() == [int((text[:i] == c).sum()) for i in at]
        assert wm.access(np.arange(n)).tolist() == text.tolist()


def test_bit_planes_abandon_nothing_near():
    rng = np.random.default_rng(5)
    lanes = rng.integers(0, 2**63, 128, dtype=np.int64).astype(np.uint64)
    lanes[5] = lanes[100] ^ np.uint64(0b111)
    planes = simhash.BitPlanes(lanes, np.ones(128, bool))
    for radius in (1, 2, 3, 5, 7):
        k, lane = planes.within(np.repeat(lanes[[5, 100]], 2), np.array([0, 1, 0, 1]), radius)
        want = {(i, j) for i, f in ((0, 5), (1, 5), (2, 100), (3, 100)) for j in range(128) if j // 64 == i % 2 and (int(lanes[f]) ^ int(lanes[j])).bit_count() <= radius}
        assert set(zip(k.tolist(), lane.tolist())) == want
