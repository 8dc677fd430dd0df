"""Merkle dataset manifest: a hash tree for each language, one over the languages, and a proof for every row.

A row's leaf is the SHA-256 of its fields.  Leaves get their place within the language by a range sort, and levels are
windows: partitioned by group and parent index and ordered by place, a full-frame collect_list gives the digests of a
run.  Together they are the parent's preimage, and without a row's own one they are its siblings.  Only the first row of a
node brings its digest to the list, so parents are deduplicated before the next level counts them.

`depth` levels share one exchange: rows are dealt by the ancestor that many levels up, whose fanout^depth rows at most
make a task's group however many rows a language has.  The next levels then start from these ancestors, one row each, and
their part of the proof is joined to the rows below.  10^10 rows take six such steps, and all but the first two are small.

Only digests are shuffled, never texts.  Windows, sorts and joins spill; a lost executor's tasks are done again from tables.

Nulls: a null field is `-`, and rows with a null lang are a group of their own, before all others.  Null doc_ids come first in
their language; rows of one doc_id go by their digest, so rows that repeat each other entirely have the same leaf and
neighbouring places.  Empty and very long texts are hashed whole like any other.  An empty table gives no rows; one row is its own root,
with the digest of nothing as its proof.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(**fields: Column) -> Column:
    """The digest of all fields: `-` for null, else UTF-8 bytes, `:`, value."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[said(fields.get(c, F.col(c)).cast("string")) for c in FIELDS]))


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """nodes with `place`, their 0-based rank within the group, and `many`, the group's size, over a range sort.

    Places follow the numbers that a sorted table's rows get within their partition; where a group begins in each partition
    comes from counts, a row for each partition and group that meet.
    """
    rows = stored(nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = rows.groupBy(group, part).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select(F.col(group).alias("_group"), "_part", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy(group)).alias("many")))
    starts = F.broadcast(starts) if starts.count() <= 200_000 else starts
    found = rows.withColumn("_part", part).join(starts, "_part").where(F.col(group).eqNullSafe(F.col("_group")))
    return found.select(*nodes.columns, (F.col("_at") + F.col("shift")).alias("place"), "many")


def over(a: Column | str, b: int) -> Column:
    """The whole part of a by b."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b).cast("long"))


def without(run: Column, at: Column) -> Column:
    return F.filter(run, lambda _, i: i != at)


def tree(nodes: DataFrame, group: str, *kept: str, fanout: int = 2, depth: int = 6) -> DataFrame:
    """(group, place, root, proof, *kept) of every node (group, place, many, hash, *kept): proof has, for every level from the
    node up, its index `at` in its run and the digests of the `others`."""
    most = nodes.agg(F.coalesce(F.max("many"), F.lit(0))).first()[0]
    steps, rest, span = [], nodes.select(group, "place", "many", "hash", *kept), fanout**depth
    while True:
        empty = F.array().cast("array<struct<at:int,others:array<string>>>")
        rows = rest.withColumns({"proof": empty, "above": over("place", span)}).repartition(group, "above")
        for k in range(depth):
            first = F.when(F.col("place") % fanout**k == 0, F.col("hash"))
            run = W.partitionBy(group, "above", "_parent").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            at, open_ = (over("place", fanout**k) % fanout).cast("int"), F.col("many") > fanout**k
            rows = rows.withColumn("_parent", over("place", fanout ** (k + 1))).withColumn("_run", F.collect_list(first).over(run))
            step = F.struct(at.alias("at"), without(F.col("_run"), at).alias("others"))
            rows = rows.withColumns({"hash": F.when(open_, digest(F.array_join("_run", ""))).otherwise(F.col("hash")), "proof": F.when(open_, F.concat("proof", F.array(step))).otherwise(F.col("proof"))})
        rows = stored(rows.drop("_parent", "_run"))
        steps.append(rows)
        if most <= span:
            break
        most = -(-most // span)
        rest = rows.where(F.col("place") % span == 0).select(group, F.col("above").alias("place"), over(F.col("many") + (span - 1), span).alias("many"), "hash")
    found = steps.pop().withColumnRenamed("hash", "root").drop("many", "above")
    while steps:
        up = found.select(F.col(group).alias("_group"), F.col("place").alias("_place"), "root", F.col("proof").alias("_proof"))
        rows = steps.pop()
        own = [c for c in rows.columns if c not in ("hash", "many", "above", "proof")]
        found = rows.join(up, F.col(group).eqNullSafe(F.col("_group")) & (F.col("above") == F.col("_place"))).select(*own, "root", F.concat("proof", "_proof").alias("proof"))
    return found


def folded(node: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and its proof lead to; it equals the manifest's root if nothing was changed."""

    def up(own: Column, step: Column) -> Column:
        rest = F.slice(step["others"], step["at"] + 1, F.size(step["others"]) + 1)
        return digest(F.concat(F.array_join(F.slice(step["others"], 1, step["at"]), ""), own, F.array_join(rest, "")))

    return F.aggregate(proof, F.col(node) if isinstance(node, str) else node, up)


def siblings(proof: Column | str) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda step: step["others"])), "")


def manifest(docs: DataFrame, fanout: int = 2, depth: int = 6, **more: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row, and columns `more` over the row's own."""
    leaves = stored(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf().alias("leaf"), *[c.alias(n) for n, c in more.items()]))
    rows = stored(placed(leaves, "lang", "doc_id", "leaf").withColumn("hash", F.col("leaf")))
    own = stored(tree(rows, "lang", "doc_id", "leaf", *more, fanout=fanout, depth=depth))
    tops = own.where("place = 0").select(F.lit(0).alias("all"), "lang", F.col("root").alias("hash"))
    ranked = stored(placed(tops, "all", "lang").withColumn("subroot", F.col("hash")))
    subroots = stored(tree(ranked, "all", "lang", "subroot", fanout=fanout, depth=depth).select(F.col("lang").alias("_lang"), "subroot", F.col("root").alias("top"), F.col("proof").alias("rest")))
    subroots = F.broadcast(subroots) if subroots.count() <= 10_000 else subroots
    found = own.join(subroots, F.col("lang").eqNullSafe(F.col("_lang")))
    return found.select("doc_id", "leaf", "subroot", F.col("top").alias("root"), F.concat("proof", "rest").alias("proof"), *more)
