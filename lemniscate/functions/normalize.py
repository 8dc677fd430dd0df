"""LaTeX normalisation profiles.

A profile is a list of steps; each step is a regular expression or literal replacement, a lower-casing, or a trim.  It is
applied as a chain of Column expressions, inside code generation, and can also be written out as SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol aliases of the default profile.
DEFAULT_SYMBOLS = {
    r"\|": "||",
    r"\Vert": "||",
    r"\lbrace": "{",
    r"\rbrace": "}",
    r"\langle": "<",
    r"\rangle": ">",
    r"\varepsilon": r"\epsilon",
    r"\vartheta": r"\theta",
    r"\varkappa": r"\kappa",
    r"\varpi": r"\pi",
    r"\varrho": r"\rho",
    r"\varsigma": r"\sigma",
    r"\varphi": r"\phi",
    r"\le": r"\leq",
    r"\ge": r"\geq",
    r"\ne": r"\neq",
    r"\to": r"\rightarrow",
    r"\gets": r"\leftarrow",
    r"\land": r"\wedge",
    r"\lor": r"\vee",
    r"\lnot": r"\neg",
    r"^H": "^T",
    r"^\dagger": "^T",
    r"^*": "^T",
}
# Symbol aliases of the question-and-answer profile.
FORUM_SYMBOLS = {
    r"\|": "||",
    r"\Vert": "||",
    r"\lbrace": "{",
    r"\rbrace": "}",
    r"\langle": "<",
    r"\rangle": ">",
    r"\varepsilon": r"\epsilon",
    r"\varphi": r"\phi",
    r"\le": r"\leq",
    r"\ge": r"\geq",
    r"\ne": r"\neq",
    r"\to": r"\rightarrow",
    r"\gets": r"\leftarrow",
    r"\implies": r"\Rightarrow",
    r"\iff": r"\Leftrightarrow",
    r"\land": r"\wedge",
    r"\lor": r"\vee",
    r"\lnot": r"\neg",
    r"\empty": r"\emptyset",
    r"\varnothing": r"\emptyset",
    r"^\top": "^T",
    r"^t": "^T",
    r"\ldots": r"\cdots",
    r"\dots": r"\cdots",
}
# Font commands, each with two backslashes as the source data's rule has them.
FONTS = (r"\\mathbf", r"\\mathrm", r"\\mathit", r"\\mathsf", r"\\mathtt", r"\\mathbb", r"\\mathcal", r"\\mathfrak", r"\\text", r"\\bm")

#: White space as Python's \s has it within ASCII; the same class in Java and RE2.
WS = r"[ \t\n\r\f\x0B]"


@dataclass(frozen=True)
class Step:
    kind: str  # "regex", "literal", "lower" or "trim"
    old: str = ""
    new: str = ""


def regex(old: str, new: str = "") -> Step:
    """new may name groups as \\1."""
    return Step("regex", old, new)


def literal(old: str, new: str = "") -> Step:
    return Step("literal", old, new)


LOWER, TRIM, COLLAPSE, SQUEEZE = Step("lower"), Step("trim"), regex(f"{WS}+", " "), regex(f"{WS}+")


def aliases(symbols: dict[str, str]) -> tuple[Step, ...]:
    """Longest alias first; equal lengths in their order."""
    return tuple(literal(k, v) for k, v in sorted(symbols.items(), key=lambda kv: -len(kv[0])))


MATRIX = (regex(r"\\(begin|end)\{[pbvV]matrix\}", r"\\\1{matrix}"),)
FONT_STEPS = tuple(literal(f) for f in FONTS)
DELIMITERS = regex(r"\$\$?|\\\[|\\\]")
FORUM_DELIMITERS = regex(r"\$\$?|\\\[|\\\]|\\\(|\\\)")
HTML_STEPS = (literal("&lt;", "<"), literal("&gt;", ">"), literal("&quot;", '"'), literal("&amp;", "&"), TRIM, regex(r"^\$+|\$+$"), regex(r"^\\begin\{equation\*?\}|\\end\{equation\*?\}$"), regex(r"^\\begin\{align\*?\}|\\end\{align\*?\}$"), TRIM, COLLAPSE)
PREPROCESS = (regex(r"\\(begin|end)\{(align\*?|equation\*?|cases)\}"), literal("\\\\", " "), literal("&"), literal(r"\limits"), literal(r"\displaystyle"), COLLAPSE, TRIM)

PROFILES: dict[str, tuple[Step, ...]] = {
    "default": (DELIMITERS, *FONT_STEPS, *aliases(DEFAULT_SYMBOLS), *MATRIX, regex(r"\\left|\\right|\\displaystyle|\\limits"), SQUEEZE, regex(r"\{+([^{}]+)\}+", r"{\1}")),
    "forum": (FORUM_DELIMITERS, *FONT_STEPS, *aliases(FORUM_SYMBOLS), *MATRIX, regex(r"\\left|\\right|\\displaystyle"), TRIM, COLLAPSE, regex(r"\{([a-zA-Z0-9])\}", r"\1")),
    "lower": (DELIMITERS, regex(r"\\dfrac|\\tfrac", r"\\frac"), regex(r"\\left|\\right"), COLLAPSE, TRIM, LOWER),
    "cased": (DELIMITERS, regex(r"\\dfrac|\\tfrac", r"\\frac"), regex(r"\\left|\\right"), COLLAPSE, TRIM),
    "spaces": (DELIMITERS, COLLAPSE, TRIM),
    "plain": (TRIM, COLLAPSE, regex(r"\\dfrac|\\tfrac", r"\\frac"), regex(r"\\left|\\right"), LOWER),
    "raw": (literal("$"), TRIM),
    "html": HTML_STEPS,
    "matching": (*HTML_STEPS, regex(r"\\dfrac|\\tfrac", r"\\frac"), regex(r"\\left|\\right"), literal(r"\cdot", r"\times"), literal("||", r"\|"), LOWER),
    "aggressive": (TRIM, COLLAPSE, regex(r"\\dfrac|\\tfrac|\\cfrac", r"\\frac"), regex(r"\\left|\\right"), regex(r"\\big|\\Big|\\bigg|\\Bigg"), regex(r"\\cdot|\\ast", r"\\times"), literal(r"\(", "("), literal(r"\)", ")"), literal(r"\[", "["), literal(r"\]", "]"), literal("||", r"\|"), regex(r"\{" + WS + r"*([0-9A-Za-z_])" + WS + r"*\}", r"\1"), LOWER),
    "preprocess": PREPROCESS,
    "basic": (*PREPROCESS, SQUEEZE, literal(r"\parallel", r"\|"), literal("||", r"\|"), literal(r"\leq", r"\le"), literal(r"\geq", r"\ge"), literal(r"\left"), literal(r"\right"), literal(r"\cdot", "*"), literal(r"\times", "*")),
}


def _java(new: str) -> str:
    """\\1 as Java has it; a lone $ can't occur."""
    out, i = "", 0
    while i < len(new):
        if new[i] == "\\" and i + 1 < len(new) and new[i + 1].isdigit():
            out, i = out + "$" + new[i + 1], i + 2
        else:
            out, i = out + new[i], i + 1
    return out


def apply_step(c: Column, step: Step) -> Column:
    if step.kind == "regex":
        return F.regexp_replace(c, F.lit(step.old), F.lit(_java(step.new)))
    if step.kind == "literal":
        return F.replace(c, F.lit(step.old), F.lit(step.new))
    return F.lower(c) if step.kind == "lower" else F.regexp_replace(c, F.lit(f"^{WS}+|{WS}+$"), F.lit(""))


def clean(c: Column | str, profile: str = "default") -> Column:
    """The normalised text; null and empty texts are empty."""
    out = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for step in PROFILES[profile]:
        out = apply_step(out, step)
    return out


def was_changed(c: Column | str, profile: str = "default") -> Column:
    """Whether the profile did more than to drop delimiters and white space."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if profile == "forum":
        plain = apply_step(apply_step(apply_step(text, FORUM_DELIMITERS), COLLAPSE), TRIM)
    else:
        plain = apply_step(apply_step(text, DELIMITERS), SQUEEZE)
    return clean(text, profile) != plain


def text_hash(c: Column) -> Column:
    """md5 in hexadecimal; an empty text has an empty hash."""
    return F.when(F.length(c) == 0, "").otherwise(F.md5(c))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(expression: str, profile: str = "default", steps: tuple[Step, ...] | None = None) -> str:
    """The profile as SQL over a text expression."""
    out = f"coalesce({expression}, '')"
    for step in PROFILES[profile] if steps is None else steps:
        if step.kind == "regex":
            out = f"regexp_replace({out}, {quoted(step.old)}, {quoted(step.new)}, 'g')"
        elif step.kind == "literal":
            out = f"replace({out}, {quoted(step.old)}, {quoted(step.new)})"
        else:
            out = f"lower({out})" if step.kind == "lower" else f"regexp_replace({out}, {quoted(f'^{WS}+|{WS}+$')}, '', 'g')"
    return out
