"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lemniscate.llm import ngram_join

from .helpers import awkward, clashing, lower, spaces, table


def grams(text, width):
    w = spaces(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def joined_by_force(texts, ids, width, least):
    sets, root = [grams(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n_links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and least[1] * len(a & b) >= least[0] * len(a | b):
                n_links += a != b
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))], n_links


def corpus(seed=5):
    """Families of edited copies of several sizes, a chain whose ends are unlike, templates that share much but aren't similar."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for n in (12, 40, 40, 90, 200):
        base = say(n)
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(own))
        texts += [" ".join(base + say(2)), " ".join(base[3:])]
    chain = say(200)
    texts += [" ".join(chain[k : k + 120]) for k in range(0, 60, 5)]
    family = say(80)
    texts += [" ".join([*family[: i % 80], f"own{i % 7}", *family[i % 80 + 1 :]]) for i in range(60)]
    template = say(70)
    for i in range(60):
        own = list(template)
        own[20], own[50] = f"a{i}", f"b{i % 9}"
        texts.append(" ".join(own))
    return texts + [w.upper() for w in texts[:4]]


@pytest.mark.parametrize("width, least, cells, members", [(3, (90, 100), 64, 3), (5, (80, 100), 1 << 12, 64), (1, (60, 100), 1 << 12, 4)])
def test_joined(spark, width, least, cells, members):
    texts = corpus() + awkward()
    ids = [(7 * i) % 1999 for i in range(len(texts))]
    got = ngram_join.joined(clashing(table(spark, texts, ids)), width, least, cells, members)
    want, n_links = joined_by_force(texts, ids, width, least)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and n_links > 100


def test_joined_through_opened_groups(spark):
    """Where hubs link nothing, groups must: members of each family are similar to their neighbours only."""
    rng = random.Random(1)
    texts = []
    for f in range(6):
        chain = [f"f{f}x{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(chain[k : k + 100]) for k in range(0, 300, 4)]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    want, _ = joined_by_force(texts, ids, 3, (90, 100))
    got = ngram_join.joined(table(spark, texts, ids).repartition(9), members=64, tokens=300, cells=1 << 8, small=0)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) == 6


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    texts = ["a b c d", "A  b c\td", None, "", "  ", "one", "one ", "one two", long, long + " tail", "x y z"]
    got = ngram_join.joined(table(spark, texts, [4, 4, 5, 6, 7, None, 9, None, 11, 10, 2])).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(4, 2, 4), (4, 2, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (None, 1, 9), (9, 1, 9), (None, 1, None), (11, 149_998, 10), (10, 149_999, 10), (2, 1, 2)]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert ngram_join.joined(table(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.joined(table(spark, [None])).collect()] == [(0, 0, 0)]


def test_token_sets():
    texts = awkward()
    for width in (1, 3, 5):
        sets = ngram_join.token_sets(pa.array(texts), width)
        assert [len(s) for s in sets] == [len(grams(t, width)) for t in texts]
        shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(texts)) for j in range(0, len(texts), 7)}
        assert shared == {(i, j): len(grams(texts[i], width) & grams(texts[j], width)) for i, j in shared}


def test_the_bound_opens_few_groups():
    import zstandard

    def group(first, *texts):
        sets, ids = ngram_join.token_sets(pa.array(texts), 1), list(range(first, first + len(texts)))
        union = np.unique(ngram_join.short(np.concatenate(sets))).tobytes()
        return ngram_join.Group(1, ids, ids, [len(x) for x in sets], [zstandard.compress(t.encode()) for t in texts], union)

    say = lambda a, b: " ".join(map(str, range(a, b)))
    a, b, c = group(0, say(0, 100), say(1000, 1100)), group(7, say(5, 105), say(50, 150)), group(9, say(20, 120))
    assert list(a.links(b, (90, 100))) == [(0, 7)] and not list(a.links(b, (95, 100)))
    assert not list(a.links(c, (90, 100))) and "sets" not in c.__dict__  # bounded away, not opened
