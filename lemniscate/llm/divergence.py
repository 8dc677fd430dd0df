"""Source divergence audit: which sources of a language use other words, and which words.

Tasks count their rows' terms by source and send one row for each; these are dealt by language and term, so that one shuffle
serves both the sources' and the language's sums.  Each language keeps the terms that occur in at least `least` of its rows.  A kept term becomes one row whose wide vector
has its count in every source of the language, in the order of the sources' names.  Higher-order functions of the JVM turn
a vector into smoothed shares, one for each source, and those into the contributions |p - q| of all pairs of sources; they
are summed on the map side, so a pair of sources leaves each task as one number.  Everything is a whole number: shares are
parts of 10^9, divided exactly as decimals.

What grows: a vector is as long as its language has sources, and the result has a row for each two sources of a
language, which is asked for.  A task holds some 500,000 terms before it gives them out, and the distinct terms of one text.  The languages' list of sources is broadcast up to `small` sources in all and joined beyond.

Nulls, empty and very long texts: null text, lang and source count as ''; a text without terms makes its group occur and
adds nothing.  A row is a document, so repeated rows count each time.  Ties in a rank go by the item's UTF-8 bytes.  A
language without kept terms has values of 0 and no terms; an empty table has no rows.  Columns other than text, lang and
source are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Terms are runs of [^\x00-\x40\x5B-\x60\x7B-\x7F]: A-Z go to a-z, other ASCII that is no letter to a space, the bytes of all else stay.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
SCALE, SMOOTHING = 1_000_000_000, 5


def tallies(batches: Iterator[pa.RecordBatch], most: int = 500_000, piece: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of a task's rows, given out whenever about `most` terms are held."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def given() -> pa.RecordBatch:
        size = np.repeat(np.arange(len(groups)), [len(n) for n, _ in groups.values()])
        lang, source = (pa.array(list(x), pa.string()).take(pa.array(size)) for x in zip(*groups))
        term = pa.array([t for n, _ in groups.values() for t in n], pa.binary())
        n = pa.array([x for n, _ in groups.values() for x in n.values()], pa.int64())
        df = pa.array([df[t] for n, df in groups.values() for t in n], pa.int64())
        return pa.RecordBatch.from_arrays([lang, source, term, n, df], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        for *group, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, df = groups.setdefault(tuple(group), (Counter(), Counter()))
            before, seen, at, text = len(n), set(), 0, text.translate(TERM_BYTES)
            while at < len(text):
                end = text.find(b" ", at + piece)
                terms = text[at : end if end >= 0 else len(text)].split()
                n.update(terms)
                seen.update(terms)
                at = end if end >= 0 else len(text)
            df.update(seen)
            held += len(n) - before
            if held >= most:
                yield given()
                groups, held = {}, 0
    if held:
        yield given()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, df: rows that hold it), dealt by language and term.  Tasks count their own rows
    first, so what is shuffled, once, is a row for each term of a task's group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    own = rows.mapInArrow(tallies, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))
    return own.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms)), exactly."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", whole(n + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + SMOOTHING * terms)) + 1


def pairs_of(a: Column, f) -> Column:
    """f(later, earlier) of all pairs of an array's elements, in the order (1, 2), (1, 3), ..., (2, 3), ..."""
    places = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)))
    return F.flatten(F.transform(places, lambda i: F.transform(F.slice(a, i + 1, F.size(a)), lambda x: f(x, F.element_at(a, i)))))


def vectors(docs: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """(lang, term, counts: occurrences in each source of the language) of the kept terms."""
    found = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    kept = counted(docs).groupBy("lang", "term").agg(F.sum("df").alias("df"), found.alias("found")).where(F.col("df") >= least)
    at = F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s), F.lit(0).cast("long")))
    return kept.join(sources, "lang").select("lang", "term", at.alias("counts"))


def audit(docs: DataFrame, least: int = 30, top: int = 50, small: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language its distance from each other one (`pair`),
    and its `top` terms above the language's share (`term`)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = stored(docs.select(text("lang"), text("source")).distinct())
    bounded = F.broadcast if groups.count() <= small else (lambda df: df)
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    wide = stored(vectors(docs, bounded(sources), least))

    totals = wide.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    totals = totals.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("totals"), F.max("terms").alias("terms"))
    languages = bounded(stored(sources.join(totals, "lang")))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    shares = F.transform("counts", lambda n, i: share(n, F.get("totals", i), F.col("terms")))
    own = wide.join(languages, "lang").select("lang", "term", "sources", "counts", shares.alias("shares"), share(add(F.col("counts")), add(F.col("totals")), F.col("terms")).alias("q"))

    far = own.select("lang", F.posexplode(pairs_of(F.col("shares"), lambda x, y: F.abs(x - y))).alias("at", "f")).groupBy("lang", "at").agg(F.sum("f").alias("value"))
    names = sources.select("lang", F.posexplode(pairs_of(F.col("sources"), lambda x, y: F.struct(y.alias("a"), x.alias("b")))).alias("at", "pair"))
    both = names.join(far, ["lang", "at"], "left").select("lang", F.coalesce("value", F.lit(0).cast("long")).alias("value"), F.explode(F.array(F.col("pair"), F.struct(F.col("pair.b").alias("a"), F.col("pair.a").alias("b")))).alias("pair"))
    distances = both.select("lang", F.col("pair.a").alias("source"), F.lit("pair").alias("part"), F.col("pair.b").alias("item"), "value")

    each = own.select("lang", "term", "q", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("shares").alias("p"))).alias("s"))
    above = each.where("s.n > 0 AND s.p > q").select("lang", F.col("s.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("s.p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return distances.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))
