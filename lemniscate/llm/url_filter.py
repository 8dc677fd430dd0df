"""URL filter: host and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton.

The automaton's transitions are one dense table; a batch of urls walks it together, one byte of every url a step.
A term counts where the bytes before and behind it are neither ASCII letters nor digits.  A url is rejected by one
strict term, or when distinct soft terms weigh `reject_weight` together.

Nulls: a null url has an empty host and path, no hits, and is allowed.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ascii_lower

STRICT = ("adult", "casino", "casinos", "escort", "escorts", "hentai", "nude", "nudes", "porn", "porno", "spam", "viagra", "warez", "xxx")
SOFT = {
    "ads": 1.0, "bet": 1.0, "bets": 1.0, "bonus": 1.0, "cam": 1.0, "cash": 1.0, "cheap": 1.0, "clickbait": 1.0, "crack": 1.0, "dating": 1.0,
    "discount": 1.0, "farm": 1.0, "free": 1.0, "hot": 1.0, "jackpot": 1.0, "keygen": 1.0, "loan": 1.0, "loans": 1.0, "payday": 1.0, "pharmacy": 1.0,
    "pills": 1.0, "poker": 1.0, "prize": 1.0, "replica": 1.0, "sexy": 1.0, "slots": 1.0, "track": 1.0, "tracker": 1.0, "win": 1.0, "winner": 1.0,
}


@dataclass(frozen=True)
class Rule:
    """action ("allow" or "block") for a host, its subdomains and the paths that start with `path`."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Automaton:
    """Aho-Corasick over bytes.  step[state, byte] is the next state; terms_at[state] are the terms that end there."""

    def __init__(self, terms: Sequence[bytes]):
        goto: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, term in enumerate(terms):
            state = 0
            for byte in term:
                if byte not in goto[state]:
                    goto[state][byte] = len(goto)
                    goto.append({})
                    ends.append([])
                state = goto[state][byte]
            ends[state].append(k)
        self.step = np.zeros((len(goto), 256), np.int32)
        fail = [0] * len(goto)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            self.step[state] = self.step[fail[state]] if state else 0
            ends[state] += ends[fail[state]] if state else []
            for byte, then in goto[state].items():
                fail[then] = int(self.step[fail[state], byte]) if state else 0
                self.step[state, byte] = then
                queue.append(then)
        self.terms_at, self.sizes = ends, np.array([len(t) for t in terms])
        self.ending = np.array([bool(e) for e in ends])

    def bounded_hits(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(text, term) for every occurrence between boundaries."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        flat = np.frombuffer(b"\0" + b"\0".join(texts[i] for i in order) + b"\0", np.uint8)
        starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(97, 123)]] = True
        state, alive = np.zeros(len(order), np.int32), len(order)
        for at in range(int(sizes[0]) if order else 0):
            while alive and sizes[alive - 1] <= at:
                alive -= 1
            place = starts[:alive] + at
            state[:alive] = self.step[state[:alive], flat[place]]
            for i in np.flatnonzero(self.ending[state[:alive]]):
                for term in self.terms_at[state[i]]:
                    first = place[i] - self.sizes[term] + 1
                    if not word[flat[first - 1]] and not word[flat[place[i] + 1]]:
                        yield order[i], term


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What stands between the host and ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, else null.  The rules are a short list, written into the plan."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = (), strict: Iterable[str] = STRICT, soft: dict[str, float] = SOFT, reject_weight: float = 2.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, n_strict, n_soft (distinct terms), soft_weight of every row; no shuffle.

    rule is null where no rule fits; verdict is then the vocabulary's.  Other columns of `pages` are not read.
    """
    strict, soft = sorted(set(strict)), {k: soft[k] for k in sorted(soft) if k not in set(strict)}
    terms, weights = [*strict, *soft], [0.0] * len(strict) + list(soft.values())
    n_strict = len(strict)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([t.encode() for t in terms])
        for batch in batches:
            urls = [u.lower() for u in as_bytes(batch.column("url"))]
            hits: list[set[int]] = [set() for _ in urls]
            for i, term in automaton.bounded_hits(urls):
                hits[i].add(term)
            hard = [sum(t < n_strict for t in h) for h in hits]
            weight = [sum(weights[t] for t in sorted(h)) for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(hard, pa.int32()), pa.array([len(h) - k for h, k in zip(hits, hard)], pa.int32()), pa.array(weight, pa.float64())], names=["id", "url", "n_strict", "n_soft", "soft_weight"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"id {kind}, url string, n_strict int, n_soft int, soft_weight double")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = judged.withColumns({"host": host, "path": path})
    by_terms = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") > 1) & (F.col("soft_weight") >= reject_weight)), "block").otherwise("allow")
    rule = longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.text)
    action = longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.action)
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, by_terms).alias("verdict"), "n_strict", "n_soft", "soft_weight")
