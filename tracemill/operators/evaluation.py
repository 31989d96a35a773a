"""Evaluation of flags against labels, intervals and required sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def confusion(flagged: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and rates of rows with booleans ``malicious`` and ``flagged``, of all or by a column."""
    bad, hit = F.col("malicious"), F.col("flagged")
    cells = {"tp": bad & hit, "fn": bad & ~hit, "fp": ~bad & hit, "tn": ~bad & ~hit}
    counted = flagged.groupBy(*([by] if by else [])).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    tp, fn, fp, tn = (F.col(n) for n in cells)
    return counted.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"))


def label_gaps(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: both anti-joins."""
    missing = rows.join(labels, key, "left_anti").select(key, F.lit("unlabelled").alias("gap"))
    return missing.unionAll(labels.join(rows, key, "left_anti").select(key, F.lit("unknown").alias("gap")))


def step_windows(steps: DataFrame, key: str, seconds: int) -> DataFrame:
    """Steps (key, ord, ts_us) with the end of their window: at most ``seconds`` later, at the next step at the latest."""
    following = F.lead("ts_us").over(Window.partitionBy(key).orderBy("ts_us", "ord"))
    return steps.select("*", F.least(F.col("ts_us") + seconds * 1_000_000, following).alias("end_us"))


def divide(observed: DataFrame, required: DataFrame, owner: str, item: str) -> DataFrame:
    """Owners that hold every required item: relational division by counting, without any pair of owners."""
    needed = required.select(item).distinct()
    held = observed.join(needed, item, "left_semi").select(owner, item).distinct().groupBy(owner).agg(F.count("*").alias("n"))
    total = needed.agg(F.count("*").alias("n"))
    return held.join(F.broadcast(total), "n", "left_semi").select(owner)  # one row is broadcast
