"""Connected components of chains, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a table in the cluster's ``spark.checkpoint.dir``."""
    return tables.store(df, "cut")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours on the least node around: the greater ones of each node, or a node with its lesser ones."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionAll(swapped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = around.join(least, "a")
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of all ``nodes`` (node), component being the least node that ``edges`` (a, b) reach.

    Rounds go on until nothing changes, some log n of them; the tables of earlier rounds are deleted.
    """
    now, mark = cut(edges.where("a <> b").distinct()), None
    while True:
        before, now = now, cut(_star(_star(now, True), False))
        tables.discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return nodes.distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
        mark = seen
