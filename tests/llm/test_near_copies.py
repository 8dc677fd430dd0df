"""Near copies against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lemniscate.llm import near_copies

from .helpers import awkward, clashing, table


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, text, edits):
    out = text.split()
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def brute(texts, ids):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    alike = []
    for i in range(len(texts)):
        for j in range(i):
            if (s := likeness(sets[i], sets[j])) >= 0.8:
                alike.append(s)
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(texts))], alike


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for n in [6, 9, 30, 80, 80, 200, 200, 400]:
        base = " ".join(rng.choice(words) for _ in range(n))
        texts += [base, *[edited(rng, words, base, k) for k in (1, 1, 2, 3, 5, 8)], base + " tail", base + " " + passage]
    chain = [rng.choice(words) for _ in range(150)]  # each like the next, the ends unlike
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 50, 7)]
    return texts + [passage + " " + " ".join(rng.choice(words) for _ in range(5)) for _ in range(10)]


def test_near_copies_against_brute_force(spark):
    texts = [t for t in awkward(n=40) if grams(t)] + corpus()
    ids = [(13 * i) % 499 for i in range(len(texts))]
    want, alike = brute(texts, ids)
    assert sum(0.8 <= s < 0.95 for s in alike) > 20
    for limits in ({}, {"block_rows": 3, "small": 2}):  # the second compares all in bit planes, by pairs of sub-blocks
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(table(spark, texts, ids), **limits).collect()}
        assert [got[i] for i in ids] == want


def test_fingerprints_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 100, 200, 3000, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        for c in {near_copies.size_class(len(a)), near_copies.size_class(len(b))}:
            bits = near_copies.SMALLEST << c
            both = [near_copies.fingerprint(x, max(bits, near_copies.SMALLEST << near_copies.size_class(len(x)))) for x in (a, b)]
            x, y = near_copies.folded(both, bits)
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_a_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(150))
    texts = sorted({edited(rng, words, base, rng.randint(1, 7)) for _ in range(300)})
    want, alike = brute(texts, range(len(texts)))
    rows = near_copies.near_copies(table(spark, texts))
    assert [r.component_id for r in rows.orderBy("doc_id").collect()] == want and len(alike) > 2000
    signed = near_copies.prefixes(table(spark, texts).select("doc_id", F.lit(0).cast("long").alias("row"), "text"), np.zeros(1 << 10, np.uint8), 5, 0.8).withColumn("node", F.xxhash64("key"))
    open_ = signed.select("node", F.col("node").alias("root"), "n", "own", "lower", F.posexplode("prefix").alias("at", "shingle"))
    every, nearest = (near_copies.candidates(open_, signed.select("node", "n", "fp"), 0.8, one).count() for one in (False, True))
    assert len(alike) <= every < 1.5 * len(alike) and nearest < 20 * 300


def pages(n, many=2):
    """Pages of one template of 70 words; `many` words of each are its own, so two of them have a similarity of 0.74."""
    out = []
    for k in range(n):
        words = [f"t{i}" for i in range(70)]
        for i in range(many):
            words[20 + 25 * i] = f"own{k}x{i}"
        out.append(" ".join(words))
    return out


def test_pages_of_a_template_meet_nowhere(spark):
    texts = pages(400)
    docs = table(spark, texts).select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    signed = near_copies.prefixes(docs, near_copies.frequencies(docs, 5, 1 << 20), 5, 0.8).withColumn("node", F.xxhash64("key"))
    assert near_copies.met_at(signed, 0.8).count() == 0
    assert [r.component_id for r in near_copies.near_copies(table(spark, texts)).orderBy("doc_id").collect()] == list(range(400))


def test_template_with_shorter_pages_and_copies(spark):
    """A page without words of its own, or cut short, has all its shingles in common with the others."""
    base = pages(1, 0)[0].split()
    texts = pages(60) + pages(8, 1) + [" ".join(base), " ".join(base[:62]), " ".join(base[3:])] + [t + " end" for t in pages(3)]
    want, _ = brute(texts, range(len(texts)))
    for limits in ({}, {"block_rows": 5, "small": 2}):
        assert [r.component_id for r in near_copies.near_copies(table(spark, texts), **limits).orderBy("doc_id").collect()] == want


def test_odd_tables(spark):
    """An empty table, a very long text, rows repeated whole, and extra columns with clashing names."""
    assert near_copies.near_copies(table(spark, ["a b"]).limit(0)).collect() == []
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000))
    rows = clashing(table(spark, [long, long + " tail", "a b c", "a b c", None, ""], [7, 3, 5, 5, None, 9])).withColumn("node", F.lit("x")).withColumn("n", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in near_copies.near_copies(rows).collect()}
    assert got == {(7, 3), (3, 3), (5, 5), (None, 9), (9, 9)}


def test_pipeline_drops_near_copies(spark, tmp_path):
    import corpus_pipeline

    texts = corpus()
    want, _ = brute(texts, range(len(texts)))
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, table(spark, [*texts, "", None, " \n"]), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) + [len(texts) + i for i in range(3)]


def test_pipeline_keeps_other_texts_under_a_repeated_id(spark, tmp_path):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = table(spark, [a, a, b, b, c, a + " tail", None, None], [1, 2, 2, 2, 3, None, 4, 4])
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, rows, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (2, b), (2, b), (3, c), (0, a + " tail"), (4, ""), (4, "")])
    assert dict(corpus_pipeline.STAGES)["simhash"](spark, rows.limit(0), str(tmp_path)).collect() == []


def test_shingles_of_one_set_are_not_shuffled(spark):
    """Only shingles of several sets leave the bitmap, whatever its size, and one that is full loses none."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(60)] + pages(20)
    docs = table(spark, texts).select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    nodes = near_copies.prefixes(docs, near_copies.frequencies(docs, 5, 1 << 20), 5, 0.8).withColumn("node", F.xxhash64("key"))
    plain = nodes.select("node", "n", "own", "lower", F.posexplode("prefix").alias("at", "shingle"))
    want = {tuple(r) for r in plain.select("node", "n", "own", "lower", "at", "shingle").collect()}
    many = {}
    for r in want:
        many[r[5]] = many.get(r[5], 0) + 1
    shared = {r for r in want if many[r[5]] > 1}
    for bits in (4, 22):
        got = {tuple(r) for r in near_copies.prefix_rows(nodes, bits).collect()}
        assert shared <= got <= want
    assert shared and len(got - shared) < 0.01 * len(want) and len(want) > 1000


def test_hubs_do_not_meet_their_shingles_again(spark, monkeypatch):
    hubs, later, plain = [], [], near_copies.stored

    def kept(df, *by):
        out = plain(df, *by)
        if "hub" in out.columns:
            hubs.extend((r.shingle, r.hub.node) for r in out.collect())
        elif {"shingle", "root"} <= set(out.columns):
            later.extend((r.shingle, r.node) for r in out.collect())
        return out

    monkeypatch.setattr(near_copies, "stored", kept)
    texts = corpus()
    want, _ = brute(texts, range(len(texts)))
    assert [r.component_id for r in near_copies.near_copies(table(spark, texts)).orderBy("doc_id").collect()] == want
    assert hubs and later and not set(hubs) & set(later)
