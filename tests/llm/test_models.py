"""URL filter, I-Match, toxicity, PPM, language and pieces against plain forms, round trips and held-out rows."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lemniscate.llm import common, imatch, language, pieces, ppm, toxicity, url_filter
from lemniscate.llm.url_filter import Rule

from .helpers import awkward, clashing, lower, spaces, table


def test_automaton_finds_all_bounded_terms():
    rng = random.Random(1)
    terms = ["ab", "b", "abc", "bca", "c-a", "a"]
    texts = ["".join(rng.choice("abc-9.") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "a"]
    got = sorted(set(url_filter.Automaton([t.encode() for t in terms]).bounded_hits([t.encode() for t in texts])))
    want = sorted({(i, k) for i, t in enumerate(texts) for k, term in enumerate(terms) if re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", t)})
    assert got == want and len(want) > 50


def test_url_verdicts(spark):
    urls = [
        (1, "http://EXAMPLE.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://casino.com/", "casino.com", "/", "com/", "allow"),
        (4, "https://casino.org/", "casino.org", "/", None, "block"),
        (5, "https://casinox.org/free", "casinox.org", "/free", None, "allow"),
        (6, "https://x.org/free/Bets", "x.org", "/free/Bets", None, "block"),
        (7, "https://x.org/free-free", "x.org", "/free-free", None, "allow"),
        (8, "https://x.net#/es/", "x.net", "", None, "allow"),
        (9, "no scheme porn", "", "", None, "block"),
        (10, None, "", "", None, "allow"),
        (11, "", "", "", None, "allow"),
        (12, "a://b://c/fr/", "b:", "//c/fr/", None, "allow"),
        (12, "http://q.net/fr/" + "z" * 5000, "q.net", "/fr/" + "z" * 5000, "net/fr/", "block"),
    ]
    rules = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/fr/"))
    pages = spark.createDataFrame([(u[0], u[1], "x", "y") for u in urls], "page_id long, url string, host string, id string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()}
    assert got == {(u[0], *u[2:]) for u in urls}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("rows", [3, 2048])
def test_edits_and_fingerprints(spark, rows, monkeypatch):
    deal = imatch.beside_next
    monkeypatch.setattr(imatch, "beside_next", lambda docs: deal(docs, rows))
    texts = awkward(n=30)
    ids = [(13 * i) % 499 for i in range(len(texts))]
    got = {r.doc_id: r for r in imatch.with_edits(clashing(table(spark, texts, ids))).collect()}
    order = sorted(zip(ids, texts))
    import hashlib

    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        q = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = collections.defaultdict(set)
    for i, t in order:
        same[t or ""].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    alone = {r.doc_id: r.fingerprint for r in imatch.fingerprints(table(spark, texts, ids)).collect()}
    assert alone == {i: r.fingerprint for i, r in got.items()}


def test_likeness_follows_overlap():
    rng = random.Random(2)
    lex = imatch.Lexicons(frozenset({b"the"}))
    for size in (30, 300, 3000):
        a = [f"w{rng.random()}" for _ in range(size)]
        b = a[: size * 3 // 4] + [f"v{rng.random()}" for _ in range(size // 4)]
        p = lex.fingerprints([" ".join(x).encode() for x in (a, b, [f"u{x}" for x in a], ["the"])])
        assert lex.likeness(p[:1], p[1:2])[0] > 0.2 > lex.likeness(p[:1], p[2:3])[0]
        assert lex.likeness(p[:1], p[:1])[0] == 1


def test_empty_tables(spark):
    none = table(spark, [])
    assert imatch.with_edits(none).count() == 0 and pieces.encoded(none).count() == 0
    assert ppm.scores(none, F.lit(False)).count() == 0
    assert language.identified(none, language.fit(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert [r.score < 1e-9 for r in toxicity.scored(table(spark, ["a", None]), model).collect()] == [True, True]


def test_ties_of_next_document(spark):
    got = imatch.with_edits(table(spark, ["a b", "a b", "c d", None], [1, 1, None, None])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]


TOXIC, CLEAN = ["rotten", "fool", "filth"], ["river", "table", "music", "green", "walk", "house", "today", "bread"]


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(20)]
        y = i % 3 == 0
        if y:
            words.insert(3, rng.choice(TOXIC))
        if rng.random() < (0.9 if y else 0.1):  # toxic texts name a group more often: the unregularised model blames it
            words.insert(5, "muslim")
        texts.append(" ".join(words) + ".")
        toxic.append(int(y))
    return texts, toxic


def test_toxicity_learns_words_and_not_groups(spark):
    texts, toxic = labelled()
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    probe = table(spark, ["a muslim walk today.", "a christian walk today.", "what a fool.", None, "", "bread " * 5000], [1000, 1001, 1002, 1003, 1004, None])
    scores = {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(clashing(table(spark, texts)).drop("label"), labels, F.col("doc_id") % 4 != 1, penalty=penalty)
        scores[penalty] = {r.doc_id: r.score for r in toxicity.scored(clashing(probe), model).collect()}
    fair, plain = scores[5.0], scores[0.0]
    assert abs(fair[1000] - fair[1001]) < 0.02 < plain[1000] - plain[1001]
    assert fair[1002] > 0.7 > fair[1000] and fair[1003] == fair[1004] < 0.7 and fair[None] < 0.7
    held = {r.doc_id: r.predicted for r in toxicity.scored(table(spark, texts), model).collect()}
    assert sum(held[i] == y for i, y in enumerate(toxic) if i % 4 == 1) >= 98


def test_toxicity_scores_in_plain_form(spark):
    texts, toxic = labelled(80)
    labels = spark.createDataFrame([*enumerate(toxic), (0, 0), (0, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, texts), labels)
    for r in toxicity.scored(table(spark, [*texts[:30], None]), model).collect():
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower()))
        active = {f for w in words for f in toxicity.features(w.encode(), model.bits)}
        z = model.bias + sum(float(model.weights[f]) for f in active)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-6 and r.predicted == (r.score >= 0.7)
    one_class = toxicity.fit(table(spark, texts), spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int"))
    assert abs(toxicity.scored(table(spark, ["any"]), one_class).first().score - 0.9) < 1e-6


def test_mixture_in_plain_form():
    rng = np.random.default_rng(3)
    model = language.Model(10, ["a", "b", "c"], np.log(rng.dirichlet(np.ones(1 << 10), 3).T).astype(np.float32))
    texts = ["".join(rng.choice(list("abcdefgh ij"), int(n))).encode() for n in (1, 50, 96, 700, 120_000)]
    share, chosen = language.infer(model, texts)
    for t, own, mask in zip(texts, share, chosen):
        grams = language.trigrams(t, model.bits)
        seg = np.array([[sum(float(model.loglik[g, k]) for g in grams[a : a + 96]) for k in range(3)] for a in range(0, len(grams), 96)])

        def em(allowed):
            p = np.array([1.0 if k in allowed else 0.0 for k in range(3)]) / len(allowed)
            like = np.exp(np.maximum(seg - seg[:, sorted(allowed)].max(axis=1, keepdims=True), -80)) * (p > 0)
            for _ in range(12):
                joint = like * p
                p = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            return p, float(np.log((like * p).sum(axis=1)).sum() + seg[:, sorted(allowed)].max(axis=1).sum())

        order = np.argsort(-em({0, 1, 2})[0], kind="stable")
        sets = [set(order[: k + 1].tolist()) for k in range(3)]
        best = max(range(3), key=lambda k: (em(sets[k])[1] - k * math.log(len(seg) + 1), -k))
        assert set(np.flatnonzero(mask).tolist()) == sets[best] and np.allclose(own, em(sets[best])[0], atol=1e-6)


def test_imatch_in_plain_form(spark):
    texts = [t or "" for t in awkward(seed=8, n=30)]
    mix = lambda x: int(common.mixed(np.array([x % 2**64], np.uint64))[0])
    words = [set(lower(t).encode().split()) for t in texts]
    df = collections.Counter(w for ws in words for w in ws)
    stop = {w for w, n in df.items() if n > len(texts) ** 0.7}
    want = []
    for ws in words:
        own, out = [mix(xxhash.xxh64_intdigest(w)) for w in ws - stop or ws], []
        for level in range(6):
            deep = [h for h in own if h >> 52 >> 2 * (6 - level) == 0]
            for subset in range(16):
                keys = sorted(mix(h + level) >> 32 for h in deep if h % 16 == subset)
                out.append(sum(mix(k ^ mix(i)) for i, k in enumerate(keys)) % 2**64 >> 48 | 1 if keys else 0)
        want.append("".join(f"{x:04x}" for x in out))
    got = imatch.with_edits(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == want

    def likeness(a, b):
        if a == b:
            return 1.0
        cut = lambda x: [[x[4 * (16 * level + k) :][:4] for k in range(16)] for level in range(6)]
        shares = []
        for x, y in zip(cut(a), cut(b)):
            used = sum(p != "0000" or q != "0000" for p, q in zip(x, y))
            shares.append((used, sum(p == q != "0000" for p, q in zip(x, y)) / max(used, 1)))
        return max((s for u, s in shares if u >= 6), default=shares[0][1])

    for r, then in zip(got, [*got[1:], got[0]]):
        assert abs(r.near_next - likeness(r.fingerprint, then.fingerprint)) < 1e-9 and abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9


def ppm_by_force(texts, held, order=5):
    words = [[w.encode() for w in spaces("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] for t in texts]
    coded = [b" ".join(ws) + b"\n" for ws in words]
    c = collections.Counter(w for ws, out in zip(words, held) if not out for w in [*ws, b""])
    n, v, trie = sum(c.values()), len(c), ppm.PlainTrie(order)
    for t, out in zip(coded, held):
        if not out:
            trie.learn(t)
    rows = []
    for ws, t in zip(words, coded):
        score, met = 0.0, [collections.Counter() for _ in ppm.OWN_NODES]
        padded = b"\n" * 7 + t
        for i, log_p in enumerate(trie.code_lengths(t, adapt=False)):
            p = 10**log_p
            if i % ppm.AT_ONCE == 0:
                met = [collections.Counter() for _ in ppm.OWN_NODES]
            for own, (k, weight) in zip(met, ppm.OWN_NODES):
                context, gram = padded[i + 7 - k : i + 7], padded[i + 7 - k : i + 8]
                p = (own[gram] + weight * p) / (own[b"?" + context] + weight)
                own[gram] += 1
                own[b"?" + context] += 1
            score += math.log10(p)
        tokens = [*ws, b""]
        rows.append((len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), score))
    return rows


@pytest.mark.parametrize("chunk_bytes, bucket_bytes, part, order", [(12 << 20, 12 << 20, 0.3, 5), (300, 100, 0.3, 5), (300, 40, 0.3, 3), (12 << 20, 12 << 20, 1.1, 5), (5000, 1, 0.2, 7)])
def test_ppm(spark, chunk_bytes, bucket_bytes, part, order):
    texts = awkward(n=25) + ["ab" * 500, "\u00e9 " * 300, "qz\u65e5"]
    rng = random.Random(4)
    held = [rng.random() < part for _ in texts]
    docs = clashing(table(spark, texts))
    rows = ppm.scores(docs, F.col("doc_id").isin([i for i, h in enumerate(held) if h]), order, chunk_bytes, bucket_bytes).orderBy("doc_id").collect()
    want = ppm_by_force(texts, held, order)
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(h, *w[:3]) for h, w in zip(held, want)]
    assert np.allclose([(r.base_score, r.score) for r in rows], [w[3:] for w in want], rtol=1e-5, atol=1e-4)


def test_ppm_of_a_very_long_text_and_awkward_ids(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(["ab", "cd", "ef", "ghi"]) for _ in range(110_000))  # more than one slice
    assert len(long) > ppm.AT_ONCE
    texts, held = [long, "ab cd", None, "ab cd"], [False, True, False, False]
    docs = table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.concat(F.lit("doc-"), F.col("doc_id"))))
    rows = {r.doc_id: r for r in ppm.scores(docs, F.when(F.col("doc_id") == "doc-1", F.lit(True))).collect()}
    want = ppm_by_force(texts, held)
    assert set(rows) == {"doc-0", "doc-1", "doc-2", None} and [rows[f"doc-{i}"].held_out for i in range(3)] == held[:3]
    for key, w in zip(("doc-0", "doc-1", "doc-2", None), want):
        assert rows[key].n_tokens == w[0] and rows[key].n_known == w[1]
        assert np.isclose(rows[key].base_score, w[3], rtol=1e-5) and np.isclose(rows[key].score, w[4], rtol=1e-5)
    empty = ppm.scores(table(spark, []), F.col("doc_id") == 1)
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "held_out"]


def test_order_of_words_matters_to_ppm(spark):
    rng = random.Random(3)
    pairs = [("red", "fox"), ("blue", "jay"), ("grey", "cat"), ("old", "owl")]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(30)]
    mixed_up = " ".join(sorted(texts[0].split()))
    rows = {r.doc_id: r for r in ppm.scores(table(spark, [*texts, texts[0], mixed_up]), F.col("doc_id") >= 30).collect()}
    assert abs(rows[30].base_score - rows[31].base_score) < 1e-9 and rows[30].score > rows[30].base_score


def test_byte_probabilities_sum_to_one():
    lines = [b"abra abc", b"x abrac", b""]
    gram, n = ppm.distinct_grams(ppm.Stream(lines, 5), np.zeros(3, bool))
    low = np.zeros(1 << 24, np.uint16)
    four = ppm.distinct(gram & np.uint64(0xFFFFFFFF))
    np.add.at(low, (four & np.uint64(0xFFFFFF)).astype(np.int64), 1)
    trie = ppm.Trie(gram, n, ppm.low_orders(low), 5)
    for context in (b"\n\n\n\n\n", b"abra ", b"zzbra", b"zzzzz", b"zzzab"):
        every = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.isclose((10.0 ** trie.log_p(every)).sum(), 1)


@pytest.mark.parametrize("bits", [6, 60])
def test_places_seen_before(bits):
    rng = np.random.default_rng(5)
    code, doc = rng.integers(0, 50, 3000).astype(np.uint64), np.sort(rng.integers(3, 9, 3000)).astype(np.int32)
    seen, want = collections.Counter(), []
    for c in zip(doc.tolist(), code.tolist()):
        want.append(seen[c])
        seen[c] += 1
    before, shared = ppm.seen_before(code, doc, bits)
    assert before.tolist() == want and shared.tolist() == [i for i, c in enumerate(zip(doc.tolist(), code.tolist())) if seen[c] > 1]
    assert ppm.seen_before(np.arange(5, dtype=np.uint64), doc[:5], bits)[1].tolist() == [] and len(ppm.seen_before(code[:0], doc[:0], bits)[0]) == 0


def test_colliding_hashes_of_grams(monkeypatch):
    monkeypatch.setattr(ppm, "mixed", lambda x: x & np.uint64(0))
    before, shared = ppm.seen_before(np.array([1, 2, 1, 1, 2], np.uint64), np.array([0, 0, 0, 1, 1], np.int32), 64)
    assert before.tolist() == [0, 0, 1, 0, 0] and shared.tolist() == [0, 2]


def test_adaptive_scores(spark):
    rows = {r.doc_id: r.score for r in ppm.adaptive_scores(table(spark, ["ab " * 50, "abcdefghijklmnopqrstuvwxyz", None])).collect()}
    assert rows[2] == pytest.approx(math.log10(1 / 256)) and rows[0] / 150 > rows[1] / 27


def sentences(spark, seed=5):
    rng = random.Random(seed)
    vocab = {"aa": ["kato", "mive", "sulo", "pari"], "bb": ["zhgr", "brok", "vrzt", "grum"], "cc": ["aeio", "ouea", "iuae", "eaoi"]}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang))
    return rows, vocab


def test_language(spark):
    rows, vocab = sentences(spark)
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else la) for i, t, la in rows] + [(1000, None, "aa"), (1001, "12 !?", "bb")], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 4 <> 2 and doc_id < 1000"))
    both = " ".join(vocab["aa"] * 40) + " " + " ".join(vocab["bb"] * 20)
    probe = docs.select("doc_id", "text").union(spark.createDataFrame([(2000, both), (2001, "x" * 200_000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in language.identified(clashing(probe), model).collect()}
    assert model.languages == ["aa", "bb", "cc"]
    assert all(got[i].lang_pred == la for i, _, la in rows if i % 4 == 2)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert [x.lang for x in got[2000].languages] == ["aa", "bb"] and 0.55 < got[2000].score < 0.8 and got[2000].lang_pred == "aa"
    assert language.has_letter("é".encode()) and not language.has_letter("１".encode())


MODEL = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def test_language_sets_of_four_and_five(spark):
    rng = random.Random(12)
    langs = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(60)] for lang, letters in zip("vwxyz", ("abcde", "fghij", "klmno", "pqrst", "uvwxy"))}
    say = lambda lang, n: " ".join(rng.choice(langs[lang]) for _ in range(n))
    model = language.fit(spark.createDataFrame([(i, say(lang, 300), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string"))
    sets = ["v", "vw", "vwx", "vwxy", "vwxyz", "wz"]
    rows = language.identified(table(spark, ["\n".join(say(lang, 200) for lang in s) for s in sets]), model).orderBy("doc_id").collect()
    assert ["".join(sorted(x.lang for x in r.languages)) for r in rows] == sets
    assert all(abs(x.share - 1 / len(s)) < 0.1 for r, s in zip(rows, sets) for x in r.languages)
    assert all(abs(sum(x.share for x in r.languages) - 1) < 1e-6 for r in rows)


@MODEL
def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    odd = ["", " ", "   ", "\n", "a\0b", "x▁y", "日本語" * 200, "🎉 é\t\n", "a" * 700, "  two  spaces ", "<s> </s> <unk> <0x0A>", "aaa bbb"]
    texts = odd + [t for t in awkward(n=40) if t is not None] + ["".join(rng.choice("abcdeo nst\n.é") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for batch in (200, 1 << 20):
        got = pieces.encoded(clashing(table(spark, [*texts, None])), batch_bytes=batch).orderBy("doc_id").collect()
        assert [list(r.ids) for r in got] == [sp.encode(t) for t in texts] + [[]]
        assert all(r.round_trip == ("▁" not in t) and r.n_tokens == len(r.ids) for r, t in zip(got, [*texts, ""]))
    back = pieces.decoded(spark.createDataFrame([(1, sp.encode("a b\n é")), (2, None), (3, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["a b\n é", None, ""]
    odd = pieces.decoded(spark.createDataFrame([(1, [None, 10**9, -1, *sp.encode("ab")])], "doc_id long, ids array<int>")).first()
    assert odd.text.startswith("\ufffd\ufffd\ufffd") and odd.text.endswith("ab")


@MODEL
def test_pipeline(spark, tmp_path):
    import sys

    import corpus_pipeline

    texts, toxic = labelled(120)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    body = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    leak, line = " ".join(words[100:115]), "this very line stands in many of the documents here"
    docs = texts + body + [body[0], body[1] + " tail"] + [body[i] + "\n" + line for i in range(2, 10)] + [" ".join(f"fresh{i}" for i in range(40)) + " " + leak] + ["", None]
    docs[122] = body[2][::-1] + "\n" + line
    docs = [d if d is None else d for d in docs]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(i in rows for i, y in enumerate(toxic) if y)
    assert 150 not in rows and 120 in rows  # an exact copy goes, its first stays
    assert len(docs) - 2 in rows and len(docs) - 1 in rows  # empty texts are no copies
    leaky = len(docs) - 3
    assert pieces.decode(pieces.Vocabulary(pieces.MODEL), list(rows[leaky].ids)).decode().strip() == " ".join(f"fresh{i}" for i in range(40))
    stage = dict(corpus_pipeline.STAGES)
    after = stage["line_dedup"](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert after.columns == list(corpus_pipeline.COLUMNS) and sum(line in (r.text or "") for r in after.collect()) == 1
    assert "corpus_pipeline" in sys.modules
