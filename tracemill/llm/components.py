"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are hung on the least node of its neighbourhood: the larger ones, or the node and the smaller ones.

    A hub's neighbourhood is never gathered: its least node is a partial aggregate, and the join that
    spreads it can be split where one node has very many edges.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Stored, so that both sides of the join are plain exchanges, whose large partitions Spark can split.
    least = store(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
    spread = both.join(least, "a")
    moved = spread.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else spread.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node of its component.

    Each round is stored in the shared folder, so a lost executor repeats one round at most.
    """
    now = store(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = store(_starred(_starred(now, large=True), large=False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
