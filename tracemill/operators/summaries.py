"""Aggregates over findings: counts, risk, coverage, histograms and indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text as T

from .rules import severity_rank

# Points of a finding by severity.
POINTS = {"low": 5, "medium": 15, "high": 35, "critical": 60}
OTHER_POINTS = 10


def points(severity: Column) -> Column:
    given = F.lit(OTHER_POINTS)
    for name, value in POINTS.items():
        given = F.when(F.lower(severity) == name, value).otherwise(given)
    return given.cast("long")


def counts(findings: DataFrame, columns: Sequence[str] = ("severity", "rule_id", "technique", "host")) -> DataFrame:
    """Counts by each column for itself, in one pass; nulls count as unknown."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns])
    return findings.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def level(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 60, "high").when(score >= 30, "medium").when(score > 0, "low").otherwise("none")


def risk(findings: DataFrame) -> DataFrame:
    """One row: points of all findings, more for spread over hosts and techniques, at most 100."""
    by = findings.groupBy(F.coalesce("host", F.lit("unknown")).alias("host"), F.coalesce("technique", F.lit("unknown")).alias("technique")).agg(F.sum(points(F.col("severity"))).alias("p"))
    total = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("raw_score"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("technique").alias("n_techniques"))
    spread = F.greatest(F.lit(0), F.col("n_hosts") - 1) * 8 + F.greatest(F.lit(0), F.col("n_techniques") - 1) * 6
    scored = total.withColumn("score", F.least(F.lit(100), F.col("raw_score") + spread).cast("long"))
    return scored.withColumn("level", level(F.col("score")))


def host_risk(findings: DataFrame) -> DataFrame:
    """Score, counts, worst severity and most frequent rule (the earliest seen at a tie) of each host."""
    return host_risk_of(findings.groupBy("host", "rule_id", "severity", "technique").agg(F.count("*").alias("n"), F.min("ord").alias("seen")))


def host_risk_of(by_rule: DataFrame) -> DataFrame:
    """:func:`host_risk` of counts ``n`` and first places ``seen`` by host, rule, severity and technique."""
    rules = by_rule.groupBy("host", "rule_id").agg(F.sum("n").alias("rule_n"), F.min("seen").alias("seen")).groupBy("host").agg(F.max_by("rule_id", F.struct("rule_n", -F.col("seen"))).alias("top_rule"))
    worst = F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity")
    total = by_rule.groupBy("host").agg(F.sum("n").alias("n_findings"), F.sum(F.col("n") * points(F.col("severity"))).alias("p"), F.countDistinct("technique").alias("t"), worst)
    score = F.least(F.lit(100), F.col("p") + F.greatest(F.lit(0), F.col("t") - 1) * 8).cast("long")
    return total.join(rules, "host").select("host", "n_findings", "max_severity", "top_rule", score.alias("score"))


def coverage(findings: DataFrame, by: str = "technique") -> DataFrame:
    """Findings, hosts and worst severity per technique or another column."""
    return findings.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"), F.max(severity_rank(F.col("severity"))).cast("long").alias("max_rank"))


def hours(findings: DataFrame) -> DataFrame:
    """Findings by the hour that their time text shows; others as unknown."""
    text = F.regexp_extract("timestamp", r"^(\d{4}-\d\d-\d\d)[T ](\d\d)", 0)
    label = F.when(text == "", "unknown").otherwise(F.concat(F.translate(text, "T", " "), F.lit(":00")))
    return findings.groupBy(label.alias("hour")).agg(F.count("*").alias("n"))


def indicator_counts(rows: DataFrame, texts: Sequence[str], kinds: Sequence[str] = tuple(T.INDICATORS), patterns: dict[str, str] = T.INDICATORS) -> DataFrame:
    """Each indicator in the text columns with its number of places, and first and last ``timestamp``."""
    found = F.concat(*[T.indicators(F.coalesce(c, F.lit("")), tuple(kinds), patterns) for c in texts])
    return rows.select("timestamp", F.inline(found)).groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def top(rows: DataFrame, by: str, order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows of each group; Spark cuts each partition to that many before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def deltas(rows: DataFrame, size: int = 30) -> DataFrame:
    """The first rows in time with whole seconds since the one before: a report's timeline, bounded by its size."""
    line = Window.orderBy("ts_us", "ord")
    return rows.orderBy("ts_us", "ord").limit(size).withColumn("delta", F.floor((F.col("ts_us") - F.lag("ts_us").over(line)) / 1_000_000))
