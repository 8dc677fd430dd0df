"""What is held or sent for copies and for a shard's words."""

from lemniscate.llm import decontaminate, substring_dedup

from .helpers import table


def test_hot_strings_send_their_windows_once(spark, monkeypatch):
    texts = [f"own{i} " + " ".join(f"w{k}" for k in range(12)) + f" end{i}" for i in range(64)]
    sizes = []
    plain = substring_dedup.stored

    def counted(df, *by):
        out = plain(df, *by)
        if "w" in out.columns and "h" in out.columns:
            sizes.append((out.count(), out.select("string", "w").distinct().count()))
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    docs = table(spark, texts, list(range(64))).repartition(16)
    got = substring_dedup.without_repeated_windows(docs, 5, 3, 20, 0).orderBy("doc_id").collect()
    assert sizes and all(n == distinct for n, distinct in sizes)
    assert got[0].n_removed == 0 and all(r.n_removed == 12 for r in got[1:])


def test_hot_windows_go_once_from_each_part(spark, monkeypatch):
    """Strings that differ at their ends but share a passage send its windows once for all of a part's strings."""
    texts = [f"own{i} " + " ".join(f"w{k}" for k in range(12)) + f" end{i % 40}" for i in range(64)] + ["w3 w4 w5 w6 w7 x"]
    ids = [(17 * i) % 65 for i in range(65)]
    sent, plain = [], substring_dedup.stored

    def counted(df, *by):
        out = plain(df, *by)
        if "h" in out.columns:
            sent.append((out.count(), out.select("h").distinct().count(), out.select("bucket", "part").distinct().count()))
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    keys = ["id", "row"]
    docs = table(spark, texts, ids).repartition(8)
    spans = [sorted((r.id, sorted(x for s in r.spans for x in range(s.a, s.b))) for r in substring_dedup.covered_spans(docs, 5, 3, 20, **limits).select(*keys, "spans").collect()) for limits in ({"hot_rows": 10**6}, {"hot_rows": 0}, {"hot_rows": 0, "part_rows": 4})]
    covered = [[(i, sorted(set(x))) for i, x in own] for own in spans]
    assert len(covered[0]) > 60 and covered[0] == covered[1] == covered[2]
    assert sent[1][0] == sent[1][1] and sent[2][2] > sent[1][2] and sent[2][0] > sent[2][1]


def test_a_shards_words_are_not_held_together():
    phrases = decontaminate.Phrases([("a", b"one two three four")], 3)
    alive, most = 0, 0

    class Words(list):
        def __init__(self, *a):
            nonlocal alive, most
            super().__init__(*a)
            alive += 1
            most = max(most, alive)

        def __del__(self):
            nonlocal alive
            alive -= 1

    found = sorted(phrases.hits(Words([b"x", b"one", b"two", b"three", b"y%d" % i]) for i in range(100)))
    assert [f[:3] for f in found] == [(i, 1, 4) for i in range(100)] and most <= 2
    assert list(phrases.hits(iter([]))) == []
