"""Frames of a report, its files, and catalogues of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import attack
from tracemill.functions import text as T

from .rules import Rule, severity_rank
from .summaries import POINTS

EXCERPT, INDICATORS_PER_KIND, TOP_FINDINGS, COUNT_ROWS = 160, 50, 5, 8


def rank(severity: Column) -> Column:
    return F.coalesce(severity_rank(severity), F.lit(0))


def top_findings(findings: DataFrame, size: int = TOP_FINDINGS) -> DataFrame:
    """The gravest findings, the latest time text first, then by input."""
    ordered = findings.orderBy(F.desc(rank(F.col("severity"))), F.desc("timestamp"), "ord").limit(size)
    context = F.coalesce(T.filled(F.col("matched_context")), "matched_value", F.lit(""))
    return ordered.select("severity", "rule_name", F.coalesce("technique", F.lit("unknown")).alias("technique"), attack.name(F.col("technique")).alias("technique_name"), F.coalesce("host", F.lit("unknown")).alias("host"), "timestamp", context.alias("context"))


def tactic_coverage(findings: DataFrame) -> DataFrame:
    """Findings, techniques, hosts (how many) and worst severity by tactic, in report order by ``place``."""
    told = findings.select(attack.tactic(F.col("technique")).alias("tactic"), F.coalesce("technique", F.lit("unknown")).alias("technique"), F.coalesce("host", F.lit("unknown")).alias("host"), "severity")
    by = told.groupBy("tactic", "technique", "host").agg(F.count("*").alias("n"), F.max(rank(F.col("severity"))).alias("r"))
    found = by.groupBy("tactic").agg(F.sum("n").alias("findings"), F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"), F.countDistinct("host").alias("n_hosts"), F.max("r").alias("worst"))
    return placed(found, F.desc("worst"), F.desc("findings"), F.col("tactic"))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """A few rows with their place in an order, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def host_ranking(scores: DataFrame) -> DataFrame:
    """Hosts with a score, by score and findings; a global sort, numbered by nothing."""
    return scores.orderBy(F.desc("score"), F.desc("n_findings"), "host")


def host_severities(findings: DataFrame) -> DataFrame:
    """Findings of each severity by host."""
    return findings.groupBy("host").pivot("severity", list(POINTS)).agg(F.count(F.lit(1))).na.fill(0)


def count_rows(counts: DataFrame, by: str, size: int = COUNT_ROWS) -> DataFrame:
    """The most frequent values, by name at a tie."""
    return counts.orderBy(F.desc("n"), by).limit(size)


def indicator_rows(rows: DataFrame, texts: Sequence[str], kinds: Sequence[str] = tuple(T.INDICATORS), size: int | None = INDICATORS_PER_KIND) -> DataFrame:
    """Indicators with places, hosts (how many), rules, first and last time text; the ``size`` most frequent of each kind.

    ``rows`` are findings: timestamp, host, rule_id and the text columns; a text counts once per place in each column.
    """
    found = F.concat(*[T.indicators(F.coalesce(c, F.lit("")), tuple(kinds)) for c in texts])
    each = rows.select("timestamp", "host", "rule_id", F.inline(found)).groupBy("kind", "value", "host", "rule_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    total = each.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.countDistinct("host").alias("n_hosts"), F.array_join(F.array_sort(F.collect_set("rule_id")), ";").alias("rules"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
    if size is None:
        return total
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return total.withColumn("place", place).where(F.col("place") <= size).drop("place")


def indicator_totals(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("kind").agg(F.count("*").alias("n"))


def chain_summary(chains: DataFrame) -> DataFrame:
    """Chains, events and mean confidence by kind, and over all with kind null."""
    return chains.rollup("kind").agg(F.count("*").alias("n_chains"), F.sum("n_events").alias("n_events"), F.round(F.avg("confidence"), 6).alias("confidence"))


def scenario_summary(scenarios: DataFrame) -> DataFrame:
    """Scenarios, mean confidence and distinct techniques by stage, and over all with stage null."""
    each = scenarios.select("stage", "confidence", F.col("techniques"))
    rolled = each.rollup("stage").agg(F.count("*").alias("n_scenarios"), F.round(F.avg("confidence"), 6).alias("confidence"), F.flatten(F.collect_set("techniques")).alias("t"))
    return rolled.select("stage", "n_scenarios", "confidence", F.array_sort(F.array_distinct("t")).alias("techniques"))


def category_shares(rows: DataFrame, by: str) -> DataFrame:
    """Rows and percentage, to two places, by category."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percent"))  # one row


def even_sample(rows: DataFrame, size: int, order: Sequence[str] = ("ts_us", "ord")) -> DataFrame:
    """At most ``size`` rows spread evenly over an order, the first and last among them; the sort is distributed."""
    total = rows.count()
    if total <= size:
        return rows
    numbered = rank_by(rows, order)
    if size <= 1:
        return numbered.where("number = 0").drop("number")
    # Row i is one of them if some k has k * (total - 1) // (size - 1) = i; the least k that reaches i tells.
    k = F.ceil(F.col("number") * (size - 1) / (total - 1))
    return numbered.where((F.floor(k * (total - 1) / (size - 1)) == F.col("number")) & (k < size)).drop("number")


def rank_by(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their number from 0 in a total order, by ranges and counts rather than one task."""
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    counted = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counted.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("number", F.col("own") + F.col("before")).drop("part", "own", "before")  # a row per partition


def catalogue(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows with technique names and tactics, by id and name."""
    rows = [(r.id, r.name, r.severity, r.technique, r.operator, ",".join(r.fields or (r.field,)), r.pattern) for r in rules]
    listed = spark.createDataFrame(rows, "id string, name string, severity string, technique string, operator string, fields string, pattern string")
    return listed.withColumn("technique_name", attack.name(F.col("technique"))).withColumn("tactic", attack.tactic(F.col("technique"))).orderBy("id", "name")


def rule_coverage(rules: DataFrame) -> DataFrame:
    """Rules, techniques and worst severity by tactic in the order of an attack."""
    found = rules.groupBy("tactic").agg(F.count("*").alias("rules"), F.array_join(F.array_sort(F.collect_set(F.upper(F.coalesce("technique", F.lit("unknown"))))), ",").alias("techniques"), F.max(rank(F.col("severity"))).alias("worst"))
    return placed(found, attack.tactic_order(F.col("tactic")), F.desc("rules"))


def core_coverage(rules: DataFrame) -> DataFrame:
    """One row: how many of the core techniques have a rule, which haven't, and the percentage."""
    core = F.array(*map(F.lit, attack.CORE))
    seen = rules.agg(F.count("*").alias("n_rules"), F.count("technique").alias("n_mapped"), F.collect_set(F.upper("technique")).alias("t"))
    return seen.select("n_rules", "n_mapped", F.size(F.array_intersect(core, "t")).alias("n_core"), F.array_join(F.array_except(core, "t"), ",").alias("missing"), F.round(F.size(F.array_intersect(core, "t")) * 100 / len(attack.CORE), 1).alias("percent"))


def finding_hash() -> Column:
    """Integrity hash of a finding over its rule, its event's hash and its value."""
    event = T.event_key("timestamp", "host", "source", "event_id", "user", "command_line")
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_id", "rule_name", "severity", "technique")], event, F.coalesce("matched_value", F.lit(""))), 256)


def finding_rows(findings: DataFrame, redacted: bool = True) -> DataFrame:
    """Findings for a table file: excerpts are cut first, then redacted."""
    shown = lambda c: T.redact(F.substring(F.coalesce(c, F.lit("")), 1, EXCERPT)) if redacted else F.substring(F.coalesce(c, F.lit("")), 1, EXCERPT)
    return findings.select("timestamp", "host", F.col("rule_name").alias("rule"), "severity", F.coalesce("technique", F.lit("")).alias("mitre"), shown("command_line").alias("command_excerpt"), shown("matched_context").alias("matched_context"))


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(folder)


def write_report(findings: DataFrame, chains: DataFrame, indicators: DataFrame, folder: str, redacted: bool = True) -> None:
    """Findings and chains as JSON, findings and indicators as CSV, and the manifest of hashes."""
    masked = [T.redact(F.col(c)).alias(c) if redacted and c in ("command_line", "matched_value", "matched_context") else F.col(c) for c in findings.columns]
    findings.select(*masked).write.mode("overwrite").json(f"{folder}/findings.json")
    chains.write.mode("overwrite").json(f"{folder}/chains.json")
    write_csv(finding_rows(findings, redacted), f"{folder}/findings.csv")
    write_csv(indicators.orderBy("kind", F.desc("n"), "value"), f"{folder}/indicators.csv")
    findings.select("ord", "rule_id", finding_hash().alias("hash")).write.mode("overwrite").json(f"{folder}/manifest.json")


def write_categories(events: DataFrame, category: Column, folder: str) -> None:
    """Events as JSON lines, a folder for each artifact category."""
    events.withColumn("category", category).write.mode("overwrite").partitionBy("category").json(folder)


def write_label_index(events: DataFrame, key: Column, folder: str) -> None:
    """One row per event with empty fields for a labelling hand."""
    empty = F.array().cast("array<string>")
    events.select(key.alias("event_key"), F.lit("").alias("label"), empty.alias("expected_techniques"), F.lit("").alias("notes")).write.mode("overwrite").json(folder)


# What a summary says at each level.
_ADVICE = {"critical": "Isolate the hosts at once.", "high": "Contain the hosts today.", "medium": "Look into the findings.", "low": "Keep watching.", "none": "Nothing was found."}
_STEPS = {
    "Credential Access": "Reset the passwords of accounts seen on the hosts.", "Lateral Movement": "Check the hosts that were reached.", "Persistence": "Look for autostarts, tasks and services.",
    "Command and Control": "Block the addresses that were contacted.", "Exfiltration": "Find out what was taken.", "Impact": "Check that backups can be restored.",
}


def executive_summary(risk: DataFrame) -> DataFrame:
    """One sentence on the whole from the row of :func:`summaries.risk`, and what to do."""
    said = F.format_string("Risk is %s (%d of 100): findings on %d hosts, %d techniques.", "level", "score", "n_hosts", "n_techniques")
    return risk.select(said.alias("summary"), F.create_map(*[F.lit(x) for p in _ADVICE.items() for x in p])[F.col("level")].alias("advice"))


def checklist(coverage: DataFrame) -> DataFrame:
    """Steps that the tactics of :func:`tactic_coverage` call for, in its order."""
    steps = F.create_map(*[F.lit(x) for p in _STEPS.items() for x in p])
    return coverage.select("place", "tactic", steps[F.col("tactic")].alias("step")).where("step IS NOT NULL")




HTML_ROWS = 10_000


def write_html(title: str, risk: DataFrame, findings: DataFrame, events: DataFrame, path: str, rows: int = HTML_ROWS, redacted: bool = True) -> None:
    """One page with the risk, the top findings and an evenly spread sample of events. What reaches the driver is bounded by ``rows``."""
    import html

    def table(frame: DataFrame) -> str:
        cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        body = "".join(f"<tr>{cells('td', r)}</tr>" for r in frame.limit(rows).collect())
        return f"<table><tr>{cells('th', frame.columns)}</tr>{body}</table>"

    shown = lambda c: T.redact(F.coalesce(c, F.lit(""))).alias(c) if redacted else F.col(c)
    top = top_findings(findings, 50)
    sample = even_sample(events, rows).orderBy("ts_us", "ord").select("timestamp", "host", "source", "event_id", "user", shown("command_line"))
    parts = (("Risk", risk), ("Findings", top.withColumn("context", shown("context"))), ("Events", sample))
    page = "".join(f"<h2>{name}</h2>{table(frame)}" for name, frame in parts)
    text = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{page}"
    risk.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
