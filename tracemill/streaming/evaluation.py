"""Evaluation of detection over two streams, of events and of their labels.

Both sides meet in a full outer join by key and instant. An event whose label hasn't come by the time that
the watermark passes it is reported as unlabelled, a label without its event as unknown, so that state holds
only what is still awaited, and every event and label is reported once. Each micro-batch of results is
committed with its counts, which merge by sum into the confusion of a batch evaluation.

A row without a key is a heartbeat: it is no event and no label, but lets time pass on its side. At the end of
a finite input a heartbeat beyond the last instant and the lateness brings out what is still awaited.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import evaluation, ledger, rules, store

from .detection import timed

LABELS = "event_key string, ts_us long, label string"


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels (event_key, ts_us of the event, label) of JSON Lines files as they arrive."""
    return spark.readStream.schema(LABELS).json(folder)


def flagged(events: DataFrame, detection: Iterable[rules.Rule]) -> DataFrame:
    """(event_key, ts_us, ord, source, flagged, techniques) of each event: a projection, so that no event waits for another."""
    detection = list(detection)
    ready = rules.Prepared(events, detection)
    found = F.array_compact(F.array(*map(ready.finding, detection))) if detection else F.array()
    keyed = store.keyed(ready.events.withColumn("_found", found))
    techniques = F.array_sort(F.array_distinct(F.array_compact(F.transform("_found", lambda f: F.upper(f["technique"]))))) if detection else F.array().cast("array<string>")
    return keyed.select(F.when(F.col("event_id") != "heartbeat", F.col("event_key")).alias("event_key"), "ts_us", "ord", "source", (F.size("_found") > 0).alias("flagged"), techniques.alias("techniques"))


def scored(marked: DataFrame, labels: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of :func:`flagged` with their label, and ``gap``: unlabelled, unknown or null. Repeats count once within the lateness."""
    own = timed(marked, late).dropDuplicatesWithinWatermark(["event_key", "ts_us"])
    said = timed(labels, late).dropDuplicatesWithinWatermark(["event_key", "ts_us"]).select(F.col("event_key").alias("l_key"), F.col("ts").alias("l_ts"), F.col("ts_us").alias("l_us"), "label")
    both = own.join(said, (F.col("event_key") == F.col("l_key")) & (F.col("ts") == F.col("l_ts")), "full_outer")
    gap = F.when(F.col("event_key").isNull(), "unknown").when(F.col("l_key").isNull(), "unlabelled")
    key = F.coalesce("event_key", "l_key")
    return both.where(key.isNotNull()).select(key.alias("event_key"), F.coalesce("ts_us", "l_us").alias("ts_us"), "ord", "source", "flagged", "techniques", "label", gap.alias("gap"))


def counts(rows: DataFrame) -> DataFrame:
    """Counts by source of scored rows, which add up over batches: tp, fn, fp, tn, flagged ones to be ignored, and both gaps."""
    bad, good, hit = F.col("label") == "malicious", F.col("label") == "benign", F.col("flagged")
    whole = F.col("gap").isNull()
    cells = {"tp": whole & bad & hit, "fn": whole & bad & ~hit, "fp": whole & good & hit, "tn": whole & good & ~hit, "flagged_ignored": whole & (F.col("label") == "ignore") & hit, "unlabelled": F.col("gap") == "unlabelled", "unknown": F.col("gap") == "unknown"}
    return rows.groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def score_stream(events: DataFrame, labels: DataFrame, detection: Iterable[rules.Rule], folder: str, checkpoint: str, late: str = "10 minutes"):
    """A query that commits scored rows, in the order of time, and their counts, each micro-batch once."""
    spark = events.sparkSession
    ledger.Ledger(spark, folder).recover()

    def commit(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        batch.persist()  # two tables are made of it; if it is lost it is worked out again from the same input and state
        ledger.Ledger(spark, folder).commit(stream, number, {"scored": batch, "counts": counts(batch)})
        batch.unpersist()

    return scored(flagged(events, detection), labels, late).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def totals(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row: the counts of all batches so far, and their rates."""
    found = ledger.Ledger(spark, folder).read("counts")
    if found is None:
        return None
    names = ("tp", "fn", "fp", "tn", "flagged_ignored", "unlabelled", "unknown")
    summed = found.agg(*[F.sum(n).alias(n) for n in names])
    tp, fn, fp, tn = (F.col(n) for n in names[:4])
    rates = ((tp, tp + fp, "precision"), (tp, tp + fn, "recall"), (fp, fp + tn, "fpr"))
    return summed.select("*", *[evaluation.ratio(a, b).alias(n) for a, b, n in rates])
