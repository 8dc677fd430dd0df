"""Source divergence and the Merkle manifest against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemniscate.llm import divergence, merkle

from .helpers import COLUMNS, awkward, clashing, lower


def rows_of(texts, seed=3):
    """(doc_id, text, lang, source, n_chars) with nulls in every column, a language of one source and one of one row."""
    out = []
    for i, t in enumerate(texts):
        lang = ["en", "en", "de", None, ""][i * seed % 5]
        out.append((i * 7 % 1009, t, lang, [None, "b", "a", "ü"][i % 4], None if t is None or i % 9 == 4 else len(t)))
    return out + [(5000, "one lonely text", "zz", "only", 15), (5001, "Alpha alpha", "yy", "s", 3), (5002, None, "yy", "s", None)]


def audited_by_force(rows, least, top):
    say = lambda x: "" if x is None else x
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(say(text)))
        groups[say(lang)].add(say(source))
        counts[say(lang), say(source)].update(terms)
        df[say(lang)].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(whole[t] - own[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("least, top, small", [(1, 3, 100_000), (4, 50, 100_000), (4, 2, 0), (10_000, 5, 100_000)])
def test_divergence(spark, least, top, small):
    rows = rows_of(awkward(n=90) * 2)
    got = divergence.audit(clashing(spark.createDataFrame(rows, COLUMNS)), least, top, small).collect()
    assert {tuple(r) for r in got} == audited_by_force(rows, least, top) and len(got) == len(set(got))


def test_divergence_of_long_counts_and_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0
    n = 40_000_000_000
    found = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert found == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)
    rows = [(1, "word " * 400_000 + "other", "en", "a", 0), (2, "word", "en", "b", 0)]  # a very long text
    got = {(r.source, r.part, r.item): r.value for r in divergence.audit(spark.createDataFrame(rows, COLUMNS), 1).collect()}
    assert got == {(s, p, i): v for _, s, p, i, v, _ in audited_by_force(rows, 1, 50)}


@pytest.mark.parametrize("most, piece", [(1, 1), (7, 5), (500_000, 1 << 20)])
def test_tallies_give_out_and_cut_without_loss(most, piece):
    rows = rows_of(awkward(n=40) + ["".join(map(chr, range(0x250))) + "\u2028\u3000x\x1cy\x85z"])
    own = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source, _ in rows]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), map(list, zip(*own[i : i + 9]))))) for i in range(0, len(own), 9)]
    got, want = Counter(), Counter()
    for b in divergence.tallies(iter(batches), most, piece):
        for r in b.to_pylist():
            got.update({(r["lang"], r["source"], r["term"].decode(), k): r[k] for k in ("n", "df")})
    for lang, source, text in own:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text.decode()))
        want.update((lang, source, t, "n") for t in terms)
        want.update((lang, source, t, "df") for t in set(terms))
    assert got == want


def test_divergence_shuffles_terms_once(spark):
    """A task sends one row for each term of a group, and the language's sums need no second exchange."""
    docs = spark.createDataFrame([(i, "b a B", "en", "s", 0) for i in range(40)], COLUMNS).coalesce(1)
    kept = divergence.vectors(docs, spark.createDataFrame([("en", ["s"])], "lang string, sources array<string>").hint("broadcast"), 1)
    assert sorted(map(tuple, kept.collect())) == [("en", "a", [40]), ("en", "b", [80])]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = kept.select("*")
        assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(built, at, fanout):
    """(index in the run, the others) of each level."""
    steps = []
    for level in built[:-1]:
        run = level[at // fanout * fanout :][:fanout]
        steps.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        at //= fanout
    return steps


def manifest_by_force(rows, fanout):
    """A multiset of rows' (doc_id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([k[2] for k, _ in sorted(groups[g], key=lambda x: x[0])], fanout) for g in langs}
    top = levels([trees[g][-1][0] for g in langs], fanout)
    out = Counter()
    for i, g in enumerate(langs):
        for k, (key, r) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            steps = proof(trees[g], k, fanout) + proof(top, i, fanout)
            out[r[0], key[2], trees[g][-1][0], top[-1][0], tuple((a, tuple(o)) for a, o in steps)] += 1
    return out


@pytest.mark.parametrize("fanout, depth", [(2, 6), (2, 1), (3, 2)])
def test_manifest(spark, fanout, depth):
    rows = rows_of(awkward(n=90))
    rows += [(None, "no id", "en", "x", 5), (None, "no id either", "en", "x", 5), (7, "other text of an id", "de", "x", 1)] + rows[3:6] * 2
    got = merkle.manifest(clashing(spark.createDataFrame(rows, COLUMNS)), fanout, depth)
    steps = lambda p: tuple((s["at"], tuple(s["others"])) for s in p)
    found = got.select("doc_id", "leaf", "subroot", "root", "proof", merkle.folded("leaf", "proof").alias("up"), merkle.folded(F.sha2(F.lit("x"), 256), "proof").alias("down"), merkle.siblings("proof").alias("said")).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, steps(r.proof)) for r in found) == manifest_by_force(rows, fanout)
    assert all(r.up == r.root != r.down for r in found)
    assert all(r.said == "".join(x for s in r.proof for x in s["others"]) for r in found)


def test_manifest_of_many_partitions_one_row_and_none(spark):
    rows = [(i, f"text {i}", ["en", "de"][i % 7 == 0], "s", i) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(40), depth=3, tampered=merkle.leaf(n_chars=F.col("n_chars") + 1))
    found = got.withColumn("up", merkle.folded("tampered", "proof")).collect()
    steps = lambda p: tuple((s["at"], tuple(s["others"])) for s in p)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, steps(r.proof)) for r in found) == manifest_by_force(rows, 2)
    assert all(r.up != r.root and r.tampered == leaf(r.doc_id, f"text {r.doc_id}", ["en", "de"][r.doc_id % 7 == 0], "s", r.doc_id + 1) for r in found)
    (one,) = merkle.manifest(spark.createDataFrame([(3, "x" * 3_000_000, None, None, None)], COLUMNS)).collect()
    assert one.leaf == one.subroot == one.root == leaf(3, "x" * 3_000_000, None, None, None) and one.proof == []
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0


def test_registered_manifest_tampers_a_seventh(spark):
    from lemniscate.llm import queries

    rows = queries.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
