"""Hourly summaries of findings that merge, so that reports over time read a few rows by hour instead of all findings.

A summary row is an hour and the values of some columns, with sums and bounds that merge exactly, a HyperLogLog
sketch for each column whose distinct values are asked for, and a sketch of the most frequent values for each
column whose top is. Batches may come in any order and late: an hour may have several rows until they are
:func:`merged`. The size is hours times combinations, whatever the number of findings.

Distinct counts have a relative standard error of about 1.04 / sqrt(2 ** ``LG_K``), 1.6 %; tops are exact up to
``MOST`` * 3 / 4 different values, else a value's count is short by at most some rows / ``MOST``. Nulls count
as no value in sketches; findings without an instant fall into the hour null. Where distinct counts and tops must
be exact whatever the number of values, :func:`values` keeps a row by hour and value instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import severity_rank
from .segments import SECOND
from .summaries import host_risk_of, points, top

HOUR = 3_600 * SECOND
LG_K, MOST = 12, 10_000
SUMS = {"n": F.sum, "points": F.sum, "first_ord": F.min, "first_us": F.min, "last_us": F.max, "max_rank": F.max}


def hourly(findings: DataFrame, by: Sequence[str] = ("host", "rule_id", "severity", "technique"), distinct: Sequence[str] = (), top: Sequence[str] = ()) -> DataFrame:
    """Summary rows of findings (ord, ts_us, severity and the named columns), by one partial aggregate."""
    sketches = [F.hll_sketch_agg(c, LG_K).alias(f"{c}_distinct") for c in distinct] + [F.expr(f"approx_top_k_accumulate({c}, {MOST})").alias(f"{c}_top") for c in top]
    hour = (F.floor(F.col("ts_us") / HOUR) * HOUR).alias("hour_us")
    return findings.groupBy(hour, *by).agg(
        F.count("*").alias("n"), F.sum(points(F.col("severity"))).alias("points"), F.min("ord").alias("first_ord"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.max(severity_rank(F.col("severity"))).cast("long").alias("max_rank"), *sketches,
    )


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Summary rows folded to the given columns (``hour_us`` among them, to compact a table); sketches stay sketches."""
    sums = [f(c).alias(c) for c, f in SUMS.items()]
    distinct = [F.hll_union_agg(c).alias(c) for c in rows.columns if c.endswith("_distinct")]
    tops = [F.expr(f"approx_top_k_combine({c}, {MOST})").alias(c) for c in rows.columns if c.endswith("_top")]
    return rows.groupBy(*by).agg(*sums, *distinct, *tops)


def between(rows: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Summary rows of the whole hours from ``start_us`` to before ``end_us``."""
    if start_us % HOUR or end_us % HOUR:
        raise ValueError("summaries can be cut at whole hours only")
    return rows.where((F.col("hour_us") >= start_us) & (F.col("hour_us") < end_us))


def n_distinct(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def most(sketch: str, size: int = 5) -> Column:
    """Array of (item, count), the most frequent first, equal ones by value, nulls left out."""
    found = F.filter(F.expr(f"approx_top_k_estimate({sketch}, {MOST // 2})"), lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("item"))))
    return F.transform(F.slice(ordered, 1, size), lambda x: F.struct(x["item"].alias("item"), (-x["less"]).alias("count")))


def values(findings: DataFrame, column: str) -> DataFrame:
    """(hour_us, item, n): how often each value but null comes in each hour. Rows of several batches merge by :func:`exact`; they grow with the values, sketches don't."""
    hour = (F.floor(F.col("ts_us") / HOUR) * HOUR).alias("hour_us")
    return findings.where(F.col(column).isNotNull()).groupBy(hour, F.col(column).alias("item")).agg(F.count("*").alias("n"))


def exact(rows: DataFrame, by: str, size: int = 5) -> DataFrame:
    """(by, n_items, top) from rows of :func:`values`: exactly how many values there are, and the most frequent as (item, count), equal ones by value."""
    counted = rows.groupBy(by, "item").agg(F.sum("n").alias("n"))
    sizes = counted.groupBy(by).agg(F.count("*").alias("n_items"))
    first = top(counted, by, [F.desc("n"), F.col("item")], size).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "item"))).alias("found"))
    shown = F.transform("found", lambda x: F.struct(x["item"].alias("item"), (-x["less"]).alias("count"))).alias("top")
    groups = sizes.withColumnRenamed(by, "_by")
    return groups.join(first, F.col("_by").eqNullSafe(F.col(by))).select(by, "n_items", shown)


def host_risk(rows: DataFrame) -> DataFrame:
    """:func:`summaries.host_risk` from summary rows by host, rule, severity and technique."""
    return host_risk_of(merged(rows, "host", "rule_id", "severity", "technique").withColumnRenamed("first_ord", "seen"))
