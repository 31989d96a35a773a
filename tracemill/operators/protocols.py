"""Evaluation protocols: labelled corpora, windows of attack steps, audits of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text as T

from . import tables
from .segments import SECOND, Fold, Line

DAY = 86_400 * SECOND


def satisfies(required: Column, observed: Column) -> Column:
    """Whether an observed technique is the required one, or a part of it where a whole is required."""
    return (required == observed) | ((F.instr(required, ".") == 0) & observed.startswith(F.concat(required, F.lit("."))))


def host_equivalent(left: Column, right: Column) -> Column:
    """The same host: equal names, or one full and one short name of it."""
    a, b = T.host_name(left), T.host_name(right)
    full = F.contains(a, F.lit(".")).cast("int") + F.contains(b, F.lit(".")).cast("int")
    return (a == b) | ((T.short_host(left) == T.short_host(right)) & (full == 1))


def technique_recall(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Expected techniques by technique, and how many of them were observed for their ``key``. Both: key, technique."""
    whole = lambda c: F.substring_index(c, ".", 1)
    wanted = expected.select(key, F.upper("technique").alias("technique")).distinct()
    seen = observed.select(key, F.upper("technique").alias("seen")).distinct()
    both = wanted.withColumn("w", whole(F.col("technique"))).join(seen.withColumn("w", whole(F.col("seen"))), [key, "w"])
    met = both.where(satisfies(F.col("technique"), F.col("seen"))).select(key, "technique").distinct().withColumn("met", F.lit(1))
    return wanted.join(met, [key, "technique"], "left").groupBy("technique").agg(F.count("*").alias("expected"), F.count("met").alias("observed"))


def corpus_metrics(events: DataFrame, by: str) -> DataFrame:
    """Counts by corpus of events with ``malicious`` and ``flagged``; a rate without cases is 1, as nothing was missed."""
    n = lambda c: F.count_if(c)
    counted = events.groupBy(by).agg(
        n(F.col("malicious") & F.col("flagged")).alias("tp"), n(F.col("malicious") & ~F.col("flagged")).alias("fn"),
        n(~F.col("malicious") & F.col("flagged")).alias("fp"), n(~F.col("malicious") & ~F.col("flagged")).alias("tn"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 6)
    return counted.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))


def gates(metrics: DataFrame, least_precision: float = 0.95, least_recall: float = 0.9, least_malicious: int = 48, least_benign: int = 24) -> DataFrame:
    """One row: the totals of :func:`corpus_metrics` and whether each threshold holds."""
    total = metrics.agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select("tp", "fn", "fp", "tn", (precision >= least_precision).alias("precise"), (recall >= least_recall).alias("complete"), ((F.col("tp") + F.col("fn") >= least_malicious) & (F.col("fp") + F.col("tn") >= least_benign)).alias("large_enough"))


def benign_rates(events: DataFrame, by: str) -> DataFrame:
    """Flagged events and their rate per 1000 by source, the most flagged first."""
    counted = events.groupBy(by).agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))
    return counted.withColumn("per_1000", F.round(F.col("flagged") * 1000 / F.col("n"), 6)).orderBy(F.desc("flagged"), F.desc("per_1000"), by)


def in_windows(points: DataFrame, windows: DataFrame, key: str, widest_us: int) -> DataFrame:
    """Points (key, ord, ts_us) with each window (key, window, start_us, end_us) of their key that they fall in, ends included.

    ``widest_us`` is at least the longest window; slots of that width make it an equi-join.
    """
    slot = lambda c: F.floor(F.col(c) / widest_us)
    spread = windows.withColumn("slot", F.explode(F.sequence(slot("start_us"), slot("end_us"))))
    return points.withColumn("slot", slot("ts_us")).join(spread, [key, "slot"]).where("ts_us BETWEEN start_us AND end_us").drop("slot")


def window_of(points: DataFrame, windows: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Points with the window of their key that begins last before them, null if it has ended: for windows that don't overlap."""
    w = windows.select(key, F.col("start_us").alias("ts_us"), F.lit(None).cast("long").alias("ord"), F.lit(0).alias("role"), F.struct("window", "end_us").alias("w"))
    p = points.select(key, "ts_us", "ord", F.lit(1).alias("role"), F.lit(None).cast("struct<window:bigint,end_us:bigint>").alias("w"))
    line = Line(w.unionByName(p), [key], ["ts_us", "role", "ord"], least).fold(last=Fold("last", F.col("w")))
    return line.rows().where("role = 1").select(key, "ord", "ts_us", F.when(F.col("ts_us") < F.col("last.end_us"), F.col("last.window")).alias("window"))


def nearest_window(points: DataFrame, windows: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Points with the distance to the nearest window of their key, 0 inside; null where it has none. Windows of a key are disjoint."""
    w = windows.select(key, F.col("start_us").alias("ts_us"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("ord"), "start_us", "end_us")
    p = points.select(key, "ts_us", F.lit(1).alias("role"), "ord", F.lit(None).cast("long").alias("start_us"), F.lit(None).cast("long").alias("end_us"))
    line = Line(w.unionByName(p), [key], ["ts_us", "role", "ord"], least).fold(b=Fold("max", F.col("end_us")), a=Fold("first", F.col("start_us")))
    since = F.when(F.col("b").isNotNull(), F.greatest(F.lit(0), F.col("ts_us") - F.col("b")))
    return line.rows().where("role = 1").select(key, "ord", F.least(since, F.col("a") - F.col("ts_us")).alias("distance_us"))


def alignment(inside: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Points, distinct event ids and least delay by window; windows without a point too. ``inside``: of :func:`in_windows`, with event_id."""
    found = inside.groupBy(key, "window").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.min(F.col("ts_us") - F.col("start_us")).alias("delay_us"))
    return windows.select(key, "window").join(found, [key, "window"], "left").na.fill(0, ["n", "n_ids"])


def bounds(at: Column, after: Column, before: Column) -> Column:
    """An event's (start_us, end_us): a second around its instant, or what it happened between."""
    return F.when(at.isNotNull(), F.struct((at - SECOND).alias("start_us"), (at + SECOND).alias("end_us"))).otherwise(F.struct(after.alias("start_us"), before.alias("end_us")))


def step_outcomes(pairs: DataFrame) -> DataFrame:
    """HIT, PARTIAL or MISS by step of pairs (step, technique, hit), ERROR for one without pairs, and the share of hits."""
    counted = pairs.groupBy("step").agg(F.count("technique").alias("n"), F.count_if("hit").alias("hits"))
    outcome = F.when(F.col("n") == 0, "ERROR").when(F.col("hits") == F.col("n"), "HIT").when(F.col("hits") > 0, "PARTIAL").otherwise("MISS")
    return counted.withColumn("outcome", outcome).withColumn("share", F.round(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), 6))


def flagged(findings: DataFrame, key: Sequence[str] = ("path", "ord")) -> DataFrame:
    """Each flagged event once, with its findings nested in the order of rules and values: as many as rules at most."""
    told = [c for c in ("rule_id", "rule_name", "severity", "technique", "matched_value", "matched_context") if c in findings.columns]
    return findings.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*told))).alias("findings"))


def blind_counts(findings: DataFrame, key: Sequence[str] = ("path", "ord")) -> DataFrame:
    """Findings and distinct flagged events by rule."""
    each = findings.groupBy("rule_id", *key).agg(F.count("*").alias("n"))
    return each.groupBy("rule_id").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_events"))


def file_counts(events: DataFrame, findings: DataFrame, path: str = "path") -> DataFrame:
    """Records and findings by file, also of files without findings; a finding of no known file fails the job."""
    records, found = events.groupBy(path).agg(F.count("*").alias("n_records")), findings.groupBy(path).agg(F.count("*").alias("n_findings"))
    ok = F.when(F.col("n_records").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a finding belongs to no file")).cast("boolean"))
    return records.join(found, path, "full_outer").where(ok).na.fill(0, ["n_findings"])


def day_window(rows: DataFrame, days: int = 14, of: int = 28) -> DataFrame:
    """One row: the first and last of the last ``days`` of the distinct UTC days of ``ts_us``, how many there are, and whether ``of`` follow one another."""
    each = rows.select(F.floor(F.col("ts_us") / DAY).alias("day")).distinct()
    kept = F.slice(F.sort_array(F.collect_list("day")), -F.least(F.count("*"), F.lit(days)).cast("int"), days)
    whole = (F.count("*") == of) & (F.max("day") - F.min("day") + 1 == F.count("*"))
    found = each.agg(F.count("*").alias("n_days"), F.coalesce(whole, F.lit(False)).alias("consecutive"), kept.alias("kept"))
    return found.select("n_days", "consecutive", F.date_format(F.timestamp_seconds(F.array_min("kept") * 86400), "yyyy-MM-dd").alias("first"), F.date_format(F.timestamp_seconds(F.array_max("kept") * 86400), "yyyy-MM-dd").alias("last"))


def hourly_audit(members: DataFrame) -> DataFrame:
    """By day of members (day, hour, name, size): whether there are 24 hours, each once, and the smallest member that isn't empty."""
    found = members.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("hour").alias("n_hours"), F.min(F.when(F.col("size") > 0, F.struct("size", "name"))).alias("least"))
    return found.select("day", ((F.col("n") == 24) & (F.col("n_hours") == 24)).alias("complete"), F.col("least.name").alias("sentinel"))


def unique_or_fail(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, each once; a repeated one fails the job."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws("|", *keys))).cast("boolean"))).select(*keys)


def merge_same(rows: DataFrame, keys: Sequence[str], order: Sequence[str], strict: bool = True) -> DataFrame:
    """The first row of each identity; rows of one identity that differ fail the job if ``strict``, else are marked in ``conflict``."""
    digest = F.xxhash64(*[c for c in rows.columns if c not in order])
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("r")
    merged = rows.withColumn("_h", digest).groupBy(*keys).agg(first, (F.min("_h") != F.max("_h")).alias("conflict"))
    if not strict:
        return merged.select(*keys, "r.*", "conflict")
    return merged.where(F.when(~F.col("conflict"), F.lit(True)).otherwise(F.raise_error(F.lit("rows of one identity differ")).cast("boolean"))).select(*keys, "r.*")


def zipped(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Rows of two ordered inputs by position; a position that only one has fails the job."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    both = l.join(r, position, "full_outer")
    ok = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("inputs differ in length")).cast("boolean"))).drop("_l", "_r")


def assigned_labels(rows: DataFrame, malicious: DataFrame, unclear: DataFrame, key: str) -> DataFrame:
    """Rows with a label: malicious, ignore or benign, by membership in two sets of keys."""
    m, u = malicious.select(key).distinct().withColumn("_m", F.lit(1)), unclear.select(key).distinct().withColumn("_u", F.lit(1))
    label = F.when(F.col("_m").isNotNull(), "malicious").when(F.col("_u").isNotNull(), "ignore").otherwise("benign")
    return rows.join(m, key, "left").join(u, key, "left").withColumn("label", label).drop("_m", "_u")


def strays(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those of ``of``: none if they are a subset."""
    return rows.join(of.select(key).distinct(), key, "left_anti")


def unlinked(records: DataFrame) -> DataFrame:
    """Records (place, from_hash, to_hash) that don't begin where the one before ended."""
    line = Window.orderBy("place")  # a chain of evidence has one record per run
    return records.withColumn("expected", F.lag("to_hash").over(line)).where("expected IS NOT NULL AND NOT (expected <=> from_hash)")


def descending(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value isn't above that of the row before, by key: none if it rises throughout."""
    line = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_before", F.lag(value).over(line)).where(F.col(value) <= F.col("_before")).drop("_before")


def from_agent(rows: DataFrame, column: str = "agent", agent: str = "winlogbeat") -> DataFrame:
    """The rows, all of one agent; another one fails the job."""
    ok = F.lower(F.coalesce(column, F.lit(""))) == agent
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a row isn't from {agent}")).cast("boolean")))


def current_technique(techniques: DataFrame, revoked: DataFrame) -> DataFrame:
    """(technique, current) by following revoked (technique, by) to the end; null on a trail that runs in a circle.

    Each round doubles the length of all trails at once, so that n rounds follow 2 ** n steps.
    """
    step = revoked.select(F.col("technique").alias("a"), F.col("by").alias("b")).where("a <> b").distinct()
    ends = step.select(F.col("b").alias("a")).join(step, "a", "left_anti").select(F.col("a"), F.col("a").alias("b")).distinct()
    trail, rounds = step.unionAll(ends), 0
    while True:
        then = trail.select(F.col("a").alias("b"), F.col("b").alias("c"))
        trail = tables.store(trail.join(then, "b").select("a", F.col("c").alias("b")).distinct(), "trails")
        open_now = trail.join(ends.select(F.col("a").alias("b")), "b", "left_anti").count()
        rounds += 1
        if open_now == 0 or 1 << rounds > step.count():
            break
    done = trail.join(ends.select(F.col("a").alias("b")), "b", "left_semi")
    begun = step.select("a").distinct().withColumn("_revoked", F.lit(True))
    asked = techniques.select(F.col("technique").alias("a")).join(begun, "a", "left").join(done, "a", "left")
    return asked.select(F.col("a").alias("technique"), F.when(F.col("_revoked"), F.col("b")).otherwise(F.col("a")).alias("current"))


def dataset_outcomes(expected: DataFrame, observed: DataFrame, by: str = "dataset") -> DataFrame:
    """By data set the techniques met, missed and seen besides; both sides (by, technique), few techniques each."""
    gather = lambda rows, name: rows.groupBy(by).agg(F.collect_set(F.upper("technique")).alias(name))
    none = F.array().cast("array<string>")
    both = gather(expected, "e").join(gather(observed, "o"), by, "full_outer").select(by, F.coalesce("e", none).alias("e"), F.coalesce("o", none).alias("o"))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select(by, listed(F.array_intersect("e", "o")).alias("met"), listed(F.array_except("e", "o")).alias("missed"), listed(F.array_except("o", "e")).alias("besides"))


def reconstruction(members: DataFrame, required_hosts: Sequence[str] = (), size: int = 20) -> DataFrame:
    """The largest chains with their events, hosts, and whether they reach all required hosts. ``members``: kind, chain_id, host."""
    hosts = members.groupBy("kind", "chain_id", "host").agg(F.count("*").alias("n"))
    wanted = F.count_if(F.col("host").isin(*required_hosts)) == len(set(required_hosts)) if required_hosts else F.lit(True)
    found = hosts.groupBy("kind", "chain_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_hosts"), wanted.alias("covers"))
    return found.orderBy(F.desc("n_events"), "kind", "chain_id").limit(size)


def input_check(lines: DataFrame, needed: Sequence[str] = ("timestamp", "host", "source", "event_id")) -> DataFrame:
    """One row over JSON lines in ``value``: lines, those that aren't objects, and those that lack a needed field."""
    filled = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", "map<string,string>")
    ok = F.trim("value").startswith("{") & parsed.isNotNull() & (F.size(F.coalesce(parsed, F.create_map().cast("map<string,string>"))) > 0)
    lacks = ok & ~F.forall(F.array(*map(F.lit, needed)), lambda n: F.coalesce(parsed[n], F.lit("")) != "")
    return filled.agg(F.count("*").alias("n_lines"), F.count_if(~ok).alias("n_bad"), F.count_if(lacks).alias("n_lacking"))
