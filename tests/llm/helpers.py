"""Small document tables with every awkward row: nulls, empty and repeated texts, ties, extra columns with clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None, schema=COLUMNS):
    rows = [(ids[i] if ids else i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def awkward(seed=1, n=60):
    """Texts over a small alphabet with shared passages, copies, blank ones, unusual spaces and non-ASCII letters."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "x", "the", "of", "日本", "e!", "Zeta9"]
    shared = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(3)]
    out = [None, "", " ", "\n", "\t\x0b \x0c\r", "one", " wide space"]
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        out.append(rng.choice([" ", "\n", "\n\n", "  "]).join(parts))
    return out + out[8:12] + [out[20] + " tail"] + ["a" * 3000 + " b"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def spaces(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clashing(df):
    """The table with extra columns whose names the operators also use."""
    from pyspark.sql import functions as F

    names = ("id", "row", "key", "fp", "n_lines", "n_words", "n_removed", "score", "predicted", "spans", "items", "ids", "word", "_id", "label", "look", "block", "held", "fingerprint", "band")
    return df.select("*", *[F.lit(f"extra {n}").alias(n) for n in names if n not in df.columns])
