"""Merged hourly summaries against all findings."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rollups, summaries


@pytest.fixture(scope="module")
def findings(spark):
    n = F.col("id")
    return spark.range(60_000).select(
        n.alias("ord"), F.when(n % 5000 != 7, n * 2_000_000).alias("ts_us"), F.concat(F.lit("h"), n % 3).alias("host"), F.concat(F.lit("R"), n % 4).alias("rule_id"), F.element_at(F.array(F.lit("low"), F.lit("high")), (n % 2 + 1).cast("int")).alias("severity"),
        F.lit(None).cast("string").alias("technique"), F.concat(F.lit("u"), F.xxhash64("id") % 20_000).alias("user"), F.when(n % 10 < 6, "a").when(n % 10 < 9, "b").alias("command"),
    )


def test_sums_are_exact_and_sketches_within_their_error(findings):
    parts = [rollups.hourly(findings.where(F.col("ord") % 10 == i), ("host", "rule_id", "severity", "technique"), ("user",), ("command",)) for i in range(10)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    compact = rollups.merged(rows, "hour_us", "host", "rule_id", "severity", "technique")
    hours = findings.groupBy(F.floor(F.col("ts_us") / rollups.HOUR)).count()
    assert {(r.h, r.n) for r in rollups.merged(compact, "hour_us").select((F.col("hour_us") / rollups.HOUR).cast("long").alias("h"), "n").collect()} == {tuple(r) for r in hours.collect()}
    whole = rollups.merged(compact).select("n", "points", "first_us", "last_us", "max_rank", rollups.n_distinct("user_distinct").alias("users"), rollups.most("command_top", 3).alias("top")).first()
    assert tuple(whole)[:5] == (60_000, 30_000 * 5 + 30_000 * 35, 0, 59_999 * 2_000_000, 3)
    exact = findings.select("user").distinct().count()
    assert abs(whole.users - exact) <= 0.06 * exact
    assert [(x["item"], x["count"]) for x in whole.top] == [("a", 36_000), ("b", 18_000)]
    assert sorted(rollups.host_risk(compact).collect()) == sorted(summaries.host_risk(findings).collect())


def test_hours_are_cut_whole_and_empty_tables_stay_empty(findings):
    rows = rollups.hourly(findings)
    assert rollups.merged(rollups.between(rows, 0, 2 * rollups.HOUR)).first().n == findings.where(F.col("ts_us") < 2 * rollups.HOUR).count()
    with pytest.raises(ValueError):
        rollups.between(rows, 1, rollups.HOUR)
    assert rollups.hourly(findings.where("false"), distinct=("user",), top=("user",)).collect() == []


def test_exact_counts_of_more_values_than_sketches_hold(findings):
    rows = None
    for i in range(3):
        part = rollups.values(findings.where(F.col("ord") % 3 == i), "user")
        rows = part if rows is None else rows.unionByName(part)
    got = rollups.exact(rows.withColumn("whole", F.lit(1)), "whole", 3).first()
    users = findings.groupBy("user").count()
    expected = users.orderBy(F.desc("count"), "user").limit(3).collect()
    assert got.n_items == users.count() > rollups.MOST
    assert [tuple(x) for x in got.top] == [tuple(r) for r in expected]
