"""The prior of a document from the graph it stands in: PageRank, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(id, rank) of every node (id) after `rounds`, or once a round moves no more than `tolerance` in all; ranks sum to 1.

    Edges (src, dst) count once each, and only between nodes.  What stands on nodes without an edge out (dangling mass)
    goes to all nodes alike.  Contributions are summed before the shuffle, so a node that very many edges reach is one
    partial sum a task, and the join on src is one that adaptive execution splits.  Each round ends in a table: lineage
    stays short and lost executors cost a round at most.
    """
    nodes = saved(nodes.select("id").where("id IS NOT NULL").distinct(), "nodes")
    inner = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = saved(inner.select("src", "dst"), "edges")
    n = nodes.count()
    degrees = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    ranks = saved(nodes.join(degrees, "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / max(n, 1)).alias("rank")), "ranks")
    for _ in range(rounds):
        dangling = ranks.where("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        gives = ranks.where("out > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("gift"))
        gifts = links.join(gives, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("gift").alias("gift"))
        own = F.lit((1 - damping + damping * dangling) / max(n, 1)) + damping * F.coalesce("gift", F.lit(0.0))
        after = saved(ranks.withColumnRenamed("rank", "before").join(gifts, "id", "left").select("id", "out", "before", own.alias("rank")), "ranks")
        moved = after.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0))).first()[0]
        ranks = after.drop("before")
        if moved <= tolerance:
            break
    return ranks.select("id", "rank")
