"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lemniscate.functions import mathml, paths
from lemniscate.functions.normalize import clean, text_hash, was_changed


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first().y


CLEANED = [
    (r"$\left( x \right)$", r"\leqft(x)"),
    (r"a \to b", "aarrowb"),
    (r"x \leq y", r"x\leqqy"),
    (r"\|A\|_2", "||A||_2"),
    (r"e^{\frac{i}{n}}", r"e^{\frac{i}{n}"),
    ("{{x}}", "{x}"),
    (r"\mathbf{x}", r"\mathbf{x}"),
    (r"\begin{pmatrix}1\end{pmatrix}", r"\begin{matrix}1\end{matrix}"),
    ("x^*", "x^T"),
    (r"a \lnot b", r"a\neqgb"),
    (r"\[ \sum\limits_{i} \]", r"\sum_{i}"),
    (r"a\\\mathbf{x}", r"a\{x}"),
    (r"\varpi\varkappa", r"\pi\kappa"),
    (r"A^\dagger", "A^T"),
    ("", ""),
    (None, ""),
]


def test_default_profile(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEANED)], "i int, x string").select("i", clean("x").alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: b for i, (_, b) in enumerate(CLEANED)}


def test_empty_hash_and_flag(spark):
    row = spark.createDataFrame([("",), ("a b",)], "x string").select(text_hash(clean("x")).alias("h"), was_changed("x").alias("c")).collect()
    assert row[0].h == "" and len(row[1].h) == 32 and not row[0].c and not row[1].c


@pytest.mark.parametrize(
    "text, want",
    [
        ("x^{a+b}", "x, a, sub_a, sup_sub_a, +, sup_+, sup_+, b"),
        ("{a{b}}", "a, sub_a, sub_a, b, sub_b, sub_b"),
        (r"\sum_{i=1}^n x_i", r"\sum, i, sub_i, sub_sub_i, =, sub_=, sub_=, 1, n, sup_n, sup_n, x_i"),
    ],
)
def test_stack_paths(spark, text, want):
    assert one(spark, text, lambda c: paths.stack_paths(paths.words(c))) == want.split(", ")


def test_bigrams(spark):
    assert one(spark, "x^{a+b}", lambda c: paths.ngrams(paths.symbols(c))) == ["x->^", "^->{", "{->a", "a->+", "+->b", "b->}"]
    assert one(spark, r"\sin x", lambda c: paths.ngrams(paths.symbols(c))) == []
    assert one(spark, "abcd", lambda c: paths.ngrams(paths.symbols(c), 3)) == ["a->b->c", "b->c->d"]
    assert one(spark, None, lambda c: paths.ngrams(paths.symbols(c))) == []


def test_skeleton(spark):
    assert one(spark, "x^2 + y^2", paths.skeleton) == "V^N+V^N"
    assert one(spark, "E = mc^2", paths.skeleton) == "V=VV^N"
    assert one(spark, "E = mc^2", lambda c: text_hash(paths.skeleton(c))).startswith("47158d5bb111bbaa")
    assert one(spark, "x^2 + y^2", lambda c: text_hash(paths.skeleton(c))).startswith("1b9dae9a97c65569")


@pytest.mark.parametrize("text, want, limit", [("x^2", 0.03, 0.747), (r"\frac{a}{b}", 0.21, 0.729), ("", 0.0, 0.75), (None, 0.0, 0.75)])
def test_complexity(spark, text, want, limit):
    assert one(spark, text, paths.complexity) == pytest.approx(want)
    assert one(spark, text, lambda c: paths.adaptive_threshold(paths.complexity(c))) == pytest.approx(limit)


def test_mathml(spark):
    assert one(spark, '<math a="b"><mi>x</mi><mrow><MN>1</MN></mrow></math>', mathml.tag_skeleton) == "mi,MN"
    assert one(spark, '<math a="b"><mi>x</mi><mspace/></math>', lambda c: mathml.tag_skeleton(c, lower=True)) == "mi"
    assert one(spark, "<math><apply><plus/><ci>a</ci><cn>1</cn></apply></math>", mathml.structure) == "apply[plus,v,v]"
    assert one(spark, "<math>", mathml.structure) == "" and one(spark, None, mathml.structure) == ""
    assert one(spark, r"\frac{a}{2}", mathml.pseudo_mathml) == "mfrac,mn,mi"
    assert one(spark, "x", lambda c: mathml.converted(c, lambda t: t + "!")) == "x!"
    assert one(spark, "x", lambda c: mathml.converted(c, lambda t: 1 / 0)) is None


def test_html_formulas(spark):
    html = '<span class="math-container" id="q_1">$a &lt; b$</span><span class="math-container" id="q_2"> </span>'
    assert [(r.id, r.latex) for r in one(spark, html, mathml.html_formulas)] == [("q_1", "a < b")]


def test_first_difference(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "")], "a string, b string").select(paths.first_difference(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.y for r in rows] == [2, None, None]
