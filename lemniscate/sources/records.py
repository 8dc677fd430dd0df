"""Query and formula records: defaults, conditional fills and upgrades, and joins of shards."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a full record and what a bare formula has there.
DEFAULTS = {"latex": "", "latex_norm": "", "mathml": "", "mathml_skel": "", "mathml_source": "pseudo_mathml"}


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def standard_records(rows: DataFrame, id_col: str, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Full records: the id as text, every field of `defaults` (its default where it is null or missing), and all other columns."""
    own = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in defaults.items()]
    return rows.select(F.col(id_col).cast("string").alias("id"), *own, *[c for c in rows.columns if c not in defaults and c not in (id_col, "id")])


def with_skeletons(rows: DataFrame, skeleton: Column, column: str = "mathml_skel") -> DataFrame:
    """`column` filled where it is empty, and nowhere else."""
    return rows.withColumn(column, F.when(blank(column), skeleton).otherwise(F.col(column)))


def fill_counts(before: DataFrame, after: DataFrame, column: str = "mathml_skel") -> DataFrame:
    """One row: n, had (not empty before), have (not empty after)."""
    had = before.agg(F.count("*").alias("n"), F.count_if(~blank(column)).alias("had"))
    return had.join(F.broadcast(after.agg(F.count_if(~blank(column)).alias("have"))))


def upgraded(rows: DataFrame, convert: Callable[[Column], Column], skeleton: Callable[[Column], Column], source: str = "latexml") -> DataFrame:
    """Rows of source pseudo_mathml whose conversion gives something get its text, skeleton and source; `converted` says
    updated, failed or kept."""
    pseudo = F.col("mathml_source") == "pseudo_mathml"
    out = rows.withColumn("_new", F.when(pseudo, convert(F.col("latex"))))
    done = ~blank("_new")
    return out.select(
        *[F.when(done, new).otherwise(F.col(c)).alias(c) if (new := {"mathml": F.col("_new"), "mathml_skel": skeleton(F.col("_new")), "mathml_source": F.lit(source)}.get(c)) is not None else F.col(c) for c in rows.columns],
        F.when(done, "updated").when(pseudo, "failed").otherwise("kept").alias("converted"),
    )


def opt_with_latex(opt: DataFrame, latex: DataFrame, key: str = "id") -> DataFrame:
    """Every row of opt, with the latex of its id, an empty text where there is none."""
    return opt.join(latex.select(key, "latex"), key, "left").withColumn("latex", F.coalesce("latex", F.lit("")))


def latex_with_opt(latex: DataFrame, opt: DataFrame, digest: Callable[[Column], Column], key: str = "id") -> DataFrame:
    """Every row of latex with the opt of its id, and the digest of opt only where it has one."""
    both = latex.join(opt.select(key, "opt"), key, "left")
    return both.withColumn("opt_hash", F.when(F.col("opt").isNotNull(), digest(F.col("opt"))))


def query_visual_ids(queries: DataFrame, shards: DataFrame, key: str = "id") -> DataFrame:
    """(key, visual_id) of the queries' ids that the shards hold, the least visual id of an id that stands more than once."""
    return shards.join(queries.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min("visual_id").alias("visual_id"))


@dataclass(frozen=True)
class Settings:
    """What an experiment switches on, and its thresholds."""

    coarse: bool = True
    filter: bool = True
    graph: bool = True
    threshold: float = 0.5
    alpha: float = 0.1
    recall: int = 2000
    keep: int = 1000
    final: int = 100


def read_settings(path: str) -> Settings:
    """Settings from a JSON file, or from a flat `name: value` file; unknown names are an error, missing ones keep their default."""
    with open(path) as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        own = json.loads(text)
    else:
        lines = (line.split("#")[0].strip() for line in text.splitlines())
        own = {k.strip(): json.loads(v.strip()) for k, _, v in (line.partition(":") for line in lines if line)}
    if unknown := set(own) - {x.name for x in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**own)
