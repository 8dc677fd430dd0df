"""Tokenizers and structural paths of LaTeX texts, as higher-order Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three tokenizers' patterns.
SYMBOLS = r"\\[a-zA-Z]+|[{}]|[0-9a-zA-Z]|[+\-*/=()_^]"
WORDS = r"\\[a-zA-Z]+|[0-9A-Za-z_]+|[{}()^|_=+]"
PLAIN = r"\\[a-zA-Z]+|[a-zA-Z0-9]+"


def symbols(c: Column) -> Column:
    """Single symbols and commands, after white space is removed."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", ""), F.lit(SYMBOLS), F.lit(0))


def words(c: Column) -> Column:
    """Commands, runs of word characters, and structural symbols."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORDS), F.lit(0))


def plain_words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PLAIN), F.lit(0))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """tok->tok paths of n tokens, duplicates kept.  The token array is zipped with itself, never indexed inside a lambda."""
    size = F.size(tokens)
    out = F.slice(tokens, 1, F.greatest(size - (n - 1), F.lit(0)))
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, k, F.greatest(size - (n - 1), F.lit(0))), lambda a, b: F.concat_ws("->", a, b))
    return out


def _pop(stack: Column) -> Column:
    return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))


def stack_paths(tokens: Column) -> Column:
    """Paths of a stack machine: { and _ push "sub", ^ pushes "sup", } pops; any other token emits itself, itself under the
    innermost level, and itself under all levels, then pops one level."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("st"), empty.alias("p"))

    def step(s: Column, t: Column) -> Column:
        st, p = s["st"], s["p"]
        push = lambda name: F.struct(F.concat(st, F.array(F.lit(name))).alias("st"), p.alias("p"))
        under = F.when(F.size(st) > 0, F.array(F.concat_ws("_", F.element_at(st, -1), t), F.concat_ws("_", F.array_join(st, "_"), t))).otherwise(empty)
        emit = F.struct(_pop(st).alias("st"), F.concat(p, F.array(t), under).alias("p"))
        return F.when(t.isin("{", "_"), push("sub")).when(t == "^", push("sup")).when(t == "}", F.struct(_pop(st).alias("st"), p.alias("p"))).otherwise(emit)

    return F.aggregate(tokens, start, step, lambda s: s["p"])


def depth_tokens(c: Column) -> Column:
    """White-space tokens after braces are set apart and commands are parted from what stands before."""
    s = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("{"), F.lit(" { ")), F.lit("}"), F.lit(" } ")), F.lit("\\"), F.lit(" \\"))
    return F.regexp_extract_all(s, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))


def depth_paths(c: Column) -> Column:
    """Each token of two characters or more, or a letter, under one "sub" for each open brace."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("p"))

    def step(s: Column, t: Column) -> Column:
        kept = (F.length(t) > 1) | t.rlike("^[a-zA-Z]$")
        path = F.concat(F.repeat(F.lit("sub_"), s["depth"]), t)
        return (
            F.when(t == "{", F.struct((s["depth"] + 1).alias("depth"), s["p"].alias("p")))
            .when(t == "}", F.struct(F.greatest(s["depth"] - 1, F.lit(0)).alias("depth"), s["p"].alias("p")))
            .otherwise(F.struct(s["depth"].alias("depth"), F.when(kept, F.concat(s["p"], F.array(path))).otherwise(s["p"]).alias("p")))
        )

    return F.aggregate(depth_tokens(c), start, step, lambda s: s["p"])


def skeleton(c: Column) -> Column:
    """White space removed; commands kept; every other Latin letter is V, every digit N."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", ""), F.lit(r"\\[a-zA-Z]+|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[a-zA-Z]$"), "V").when(t.rlike("^[0-9]$"), "N").otherwise(t)), "")


def complexity(c: Column) -> Column:
    """Weighted counts of structural commands and length, at most 1; an empty text has 0."""
    c = F.coalesce(c, F.lit(""))
    many = lambda name: F.regexp_count(c, F.lit("\\\\" + name)).cast("double")
    table = F.when(F.contains(c, F.lit("matrix")) | F.contains(c, F.lit("array")), 0.3).otherwise(0.0)
    score = many("frac") * 0.1 + many("sqrt") * 0.1 + (many("int") + many("sum") + many("lim") + many("prod")) * 0.15 + table + F.least(F.length(c) / 100.0, F.lit(0.3))
    return F.when(F.length(c) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def adaptive_threshold(complexity_: Column, base: float = 0.65) -> Column:
    return F.lit(base) + 0.1 * (1 - complexity_)


def first_difference(a: Column, b: Column) -> Column:
    """0-based position of the first code point in which two texts differ; null if one is the start of the other."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1)
