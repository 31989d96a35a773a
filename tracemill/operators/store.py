"""A store of results: keyed, repeatable writes of events, findings, chains and scenarios, and queries over them.

Events and findings only grow, by rows whose key isn't there yet, and are committed together batch by batch
(``ledger``); chains and scenarios are rewritten with the latest row of each key. Writing the same frames
again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as T

from . import ledger, rules, tables

FINDING_KEY = ("event_key", "rule_id", "matched_value")
EVENT_KEY = ("timestamp", "host", "source", "event_id", "user", "command_line")


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(folder) if there else None


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_key", T.event_key(*EVENT_KEY))


def fresh(rows: DataFrame, known: DataFrame | None, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """The first row of each key that ``known`` lacks."""
    new = rows if known is None else rows.join(known.select(*keys), list(keys), "left_anti")
    others = [c for c in rows.columns if c not in (*keys, order)]
    first = F.min_by(F.struct(order, *others), order).alias("r")
    return new.groupBy(*keys).agg(first).select(*keys, "r.*").select(*rows.columns)


def latest(known: DataFrame | None, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known rows without those that ``rows`` replace, and ``rows``; of repeated keys in ``rows`` one stays."""
    single = rows.dropDuplicates(list(keys))
    return single if known is None else known.join(single.select(*keys), list(keys), "left_anti").unionByName(single)


def append(events: DataFrame, folder: str, stream: str, batch: int, detection: Iterable[rules.Rule] = (), offsets: str | None = None) -> bool:
    """Commit the events whose key isn't stored, and the findings of rules in them, as one batch; False if it was committed before."""
    spark = events.sparkSession
    book = ledger.Ledger(spark, folder)
    if book.has(stream, batch):
        return False
    rows = tables.store(keyed(events), "batch")
    new = tables.store(fresh(rows, book.known("events", rows.select("event_key", "ts_us")), ["event_key"]), "fresh")
    parts = {"events": new}
    if detection := list(detection):
        parts["findings"] = keyed(rules.detect(new, detection, distinct=False))  # keys of new events differ, so no finding comes twice
    done = book.commit(stream, batch, parts, offsets)
    tables.discard(rows, new)
    return done


def _next(book: ledger.Ledger, stream: str) -> int:
    return 1 + max((e["batch"] for e in book.entries() if e["stream"] == stream), default=-1)


def store_events(events: DataFrame, folder: str) -> None:
    """Appends events whose key isn't stored."""
    append(events, folder, "events", _next(ledger.Ledger(events.sparkSession, folder), "events"))


def store_findings(findings: DataFrame, folder: str) -> None:
    """Appends findings whose event is stored and that aren't there; only commits that may hold their events are read."""
    book = ledger.Ledger(findings.sparkSession, folder)
    rows = tables.store(keyed(findings), "batch")
    events, known = book.known("events", rows.select("event_key", "ts_us")), book.read("findings")
    bound = rows.where("false") if events is None else rows.join(events, "event_key", "left_semi")
    book.commit("findings", _next(book, "findings"), {"findings": fresh(bound, known, FINDING_KEY)})
    tables.discard(rows)


def store_replaced(rows: DataFrame, keys: Sequence[str], folder: str, name: str, generation: str) -> None:
    """Writes a table's next generation, with ``rows`` in place of those of the same keys. Readers name the generation that they read."""
    spark = rows.sparkSession
    at = f"{folder}/{name}"
    last = _read(spark, f"{at}/current")
    known = spark.read.parquet(f"{at}/{last.first()['generation']}") if last is not None else None
    latest(known, rows, keys).write.parquet(f"{at}/{generation}")
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("overwrite").parquet(f"{at}/current")


def store_chains(chains: DataFrame, members: DataFrame, folder: str, generation: str) -> None:
    store_replaced(chains, ["chain_id"], folder, "chains", generation)
    store_replaced(members, ["chain_id", "ord"], folder, "members", generation)


def store_scenarios(scenarios: DataFrame, folder: str, generation: str) -> None:
    """Scenarios by id; lists of techniques as JSON."""
    store_replaced(scenarios.withColumn("techniques", F.to_json("techniques")), ["scenario_id"], folder, "scenarios", generation)


def query_events(events: DataFrame, host: str | None = None, source: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Events by host and source, at times from ``start`` on and up to ``end`` (texts), the latest first; at most ``limit``, None for all."""
    for column, value in (("host", host), ("source", source)):
        events = events.where(F.col(column) == value) if value else events
    events = events.where(F.col("timestamp") >= start) if start else events
    events = events.where(F.col("timestamp") <= end) if end else events
    ordered = events.orderBy(F.desc("timestamp"), "ord")
    return ordered if limit is None else ordered.limit(limit)


def in_window(rows: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Rows from the start on and before the end."""
    return rows.where((F.col("ts_us") >= start_us) & (F.col("ts_us") < end_us))


def query_findings(findings: DataFrame, events: DataFrame, severity: str | None = None, technique: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Findings with host, user and command of their event, if it is stored."""
    findings = findings.where(F.col("severity") == severity) if severity else findings
    findings = findings.where(F.col("technique") == technique) if technique else findings
    about = events.select("event_key", F.col("host").alias("event_host"), F.col("user").alias("event_user"), F.col("command_line").alias("event_command"))
    joined = findings.join(about, "event_key", "left").orderBy(F.desc("timestamp"), "ord", "rule_id")
    return joined if limit is None else joined.limit(limit)


def statistics(events: DataFrame, findings: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: events, hosts, findings and chains stored."""
    of_events = events.agg(F.count("*").alias("n_events"), F.countDistinct("host").alias("n_hosts"))
    return of_events.crossJoin(findings.agg(F.count("*").alias("n_findings"))).crossJoin(chains.agg(F.count("*").alias("n_chains")))  # one row each
