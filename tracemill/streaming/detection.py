"""Incremental forms over a stream of events: deduplication, detection, parents, sessions, counts by hour, and a merging sink."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators import ledger, rules, store
from tracemill.operators.logons import LOGOFF, LOGON
from tracemill.sources import events as sources


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of JSON Lines files as they arrive in a folder; a hash of the record stands for their order."""
    lines = spark.readStream.text(folder)
    return sources.from_json_lines(lines.select("value", F.xxhash64("value").alias("ord")))


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


def findings(events: DataFrame, detection: Iterable[rules.Rule], late: str = "10 minutes") -> DataFrame:
    """Findings, each once: repeats are dropped for as long as the watermark keeps their key in state."""
    found = rules.detect(events, detection, distinct=False)
    return timed(found, late).dropDuplicatesWithinWatermark(["rule_id", "timestamp", "host", "source", "event_id", "matched_value"])


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts by hour and source; an hour is final when the watermark has passed it."""
    return timed(events, late).groupBy(F.window("ts", "1 hour").alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "source", "n")


def first_records(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with ``record_id`` once per identity, for as long as the watermark keeps it; others as they come."""
    key = ["timestamp", "host", "source", "event_id", "channel", "record_id"]
    marked = events.withColumn("record_id", F.coalesce("record_id", F.concat(F.lit("row "), F.col("ord").cast("string"))))
    return timed(marked, late).dropDuplicatesWithinWatermark(key)


_PARENT = "ord long, ts_us long, host string, parent_name string, parent_age_us long"


def parents(creations: DataFrame, late: str = "10 minutes", seconds: int = 300) -> DataFrame:
    """Process creations (ord, ts_us, host, child, parent, name) with the name of the latest one before, of ``seconds`` at most, that made their parent id.

    State is one creation per host and process id, and goes when it is too old to count.
    """
    asks = creations.where("parent IS NOT NULL").select("ord", "ts_us", F.lower("host").alias("host"), F.col("parent").alias("pid"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("role"))
    makes = creations.where("child IS NOT NULL AND name <> ''").select("ord", "ts_us", F.lower("host").alias("host"), F.col("child").alias("pid"), "name", F.lit(2).alias("role"))

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(frames).sort_values(["ord", "role"]).itertuples():
            if r.role == 2:
                last = (int(r.ts_us), r.name)
            elif last is not None and 0 <= r.ts_us - last[0] <= seconds * 1_000_000:
                out.append((int(r.ord), int(r.ts_us), key[0], last[1], int(r.ts_us - last[0])))
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ord", "ts_us", "host", "parent_name", "parent_age_us"])

    both = timed(asks.unionByName(makes), late)
    return both.groupBy("host", "pid").applyInPandasWithState(follow, _PARENT, "ts_us long, name string", "append", GroupStateTimeout.EventTimeTimeout)


_SESSION = "host string, session string, start_us long, end_us long, n_events long, closed boolean"


def sessions(events: DataFrame, late: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """Logon sessions of two events or more (events: ord, ts_us, host, event_id, session), as they end: by a logoff, the next logon, or a long silence."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], state.get if state.exists else None

        def end(closed: bool) -> None:
            if now is not None and now[2] > 1:
                out.append((*key, *now, closed))

        if state.hasTimedOut:
            end(False)
            now = None
        else:
            for r in pd.concat(frames).sort_values(["ts_us", "ord"]).itertuples():
                at = int(r.ts_us)
                if r.event_id == LOGON:
                    end(False)
                    now = (at, at, 1)
                elif now is not None:
                    now = (now[0], at, now[2] + 1)
                    if r.event_id == LOGOFF:
                        end(True)
                        now = None
        if now is None:
            state.remove()
        else:
            state.update(now)
            state.setTimeoutTimestamp(max(now[1] // 1000 + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["host", "session", "start_us", "end_us", "n_events", "closed"])

    named = timed(events.where("session IS NOT NULL").select("ord", "ts_us", F.lower("host").alias("host"), "event_id", "session"), late)
    return named.groupBy("host", "session").applyInPandasWithState(follow, _SESSION, "start_us long, end_us long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def store_stream(events: DataFrame, folder: str, checkpoint: str, detection: Iterable[rules.Rule] = ()):
    """A query that commits each micro-batch, events and findings together, into the store.

    What an interrupted batch left is deleted first; a batch that was committed but not yet marked in the
    checkpoint adds nothing. The ledger names the stream by the checkpoint's id, so that a new checkpoint, whose
    batches are numbered anew, is another stream, and keeps where the source stood.
    """
    spark, detection = events.sparkSession, list(detection)
    ledger.Ledger(spark, folder).recover()

    def written(name: str) -> str | None:
        found = [r.value for r in spark.read.text(f"{checkpoint}/{name}").collect()]
        return "\n".join(found)

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, folder, json.loads(written("metadata"))["id"], number, detection, written(f"offsets/{number}"))

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
