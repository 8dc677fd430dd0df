"""MathML skeletons, structural strings and pseudo-MathML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import clean

# Wrapper tags that a skeleton leaves out.
WRAPPERS = ("math", "semantics", "annotation", "mstyle", "mrow")
MORE_WRAPPERS = ("math", "semantics", "annotation", "annotation-xml", "mstyle", "mrow", "mtext", "mspace")
# Operators of which each one present gives an "mo".
OPERATORS = (r"\times", r"\div", "+", "-", "=", r"\leq", r"\geq", r"\in")


def tag_skeleton(xml: Column, lower: bool = False) -> Column:
    """Open tags but wrappers, comma-joined: in their own case, or lower-cased and with more wrappers left out."""
    bare = F.regexp_replace(F.coalesce(xml, F.lit("")), r'[ \t\n\r\f\x0B]+[a-z]+="[^"]' + ("*" if lower else "+") + '"', "")
    tags = F.regexp_extract_all(bare, F.lit("<([a-zA-Z0-9]+)"), F.lit(1))
    kept = F.filter(tags, lambda t: ~F.lower(t).isin(*(MORE_WRAPPERS if lower else WRAPPERS)))
    return F.array_join(F.transform(kept, F.lower) if lower else kept, ",")


def pseudo_mathml(latex: Column) -> Column:
    """Tags for the structures that a LaTeX text mentions, in a fixed order."""
    c = clean(latex, "html")
    has = lambda x: F.contains(c, F.lit(x))
    parens = F.regexp_count(c, F.lit(r"\(|\[|\\\{"))
    parts = [
        F.when(has(r"\frac"), "mfrac"),
        F.when(has(r"\sqrt"), "msqrt"),
        F.when(has("^"), "msup"),
        F.when(has("_"), "msub"),
        F.when(has(r"\int"), "mo,mo"),
        F.when(has(r"\sum"), "mo,mo"),
        F.when(has(r"\lim"), "mo"),
        F.when(has(r"\begin{") & has("matrix"), "mtable,mtr,mtd"),
        F.when(parens > 0, F.array_join(F.array_repeat(F.lit("mo"), F.least(parens, F.lit(3))), ",")),
        *[F.when(has(o), "mo") for o in OPERATORS],
        F.when(c.rlike("[0-9]"), "mn"),
        F.when(c.rlike("[a-zA-Z]"), "mi"),
    ]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ",")


def _structure(node: ET.Element, leaves: frozenset[str]) -> str:
    tag = node.tag.rsplit("}", 1)[-1].lower()
    if tag in leaves:
        return "v"
    inner = [s for s in (_structure(child, leaves) for child in node) if s]
    if tag in MORE_WRAPPERS:
        return "".join(inner)
    return f"{tag}[{','.join(inner)}]" if inner else tag


def structure(xml: Column, leaves: tuple[str, ...] = ("ci", "cn")) -> Column:
    """The tree as nested tags, identifiers and numbers as v; empty where the text doesn't parse.  A tree walk: an Arrow UDF."""
    names = frozenset(leaves)

    def one(text: str | None) -> str:
        try:
            return _structure(ET.fromstring(text), names) if text else ""
        except ET.ParseError:
            return ""

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return walk(F.regexp_replace(xml, r'[ \t\n\r\f\x0B]+(xmlns|encoding)="[^"]+"', ""))


def converted(latex: Column, converter: Callable[[str], str | None]) -> Column:
    """An outside converter (LaTeX to MathML, symbolic simplification) as an Arrow UDF; failures are null."""

    def one(text: str | None) -> str | None:
        try:
            return converter(text) if text else None
        except Exception:  # whatever the tool raises, the row has no conversion
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(latex)


def html_formulas(html: Column) -> Column:
    """array<struct<id,latex>> of the formula spans of a page, cleaned, empty ones left out."""
    pattern = r'(?s)<span class="math-container" id="(q_\d+)">(.*?)</span>'
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("latex"))
    clean_ = F.transform(both, lambda s: F.struct(s["id"].alias("id"), clean(s["latex"], "html").alias("latex")))
    return F.filter(clean_, lambda s: F.length(s["latex"]) > 0)
