"""Commits of several tables at once: crashes between them, repeated batches, pruning, compaction, and the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import ledger, store
from tracemill.operators.rules import Rule
from tracemill.sources import events as sources
from tracemill.streaming import detection

RULES = [Rule("S", "sevens", "command_line", "--job 7", "contains")]


def hours(spark, first, last):
    return sources.synthetic(spark, 200).where(F.col("ord").between(first, last))


def counts(spark, folder):
    book = ledger.Ledger(spark, folder)
    return {name: (book.read(name).count(), book.read(name).select("event_key").distinct().count()) for name in ("events", "findings")}


def test_a_bloom_filter_has_all_its_keys_and_few_others(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_key"))
    maps = ledger.bloom(keys.where("true").limit(1500), 1)
    asked = keys.select("event_key", ledger._hash().alias("h")).crossJoin(maps).select("event_key", *[ledger._bit(F.col("bitmap"), ledger._positions(F.col("h"))[k]).alias(f"b{k}") for k in (0, 1)])
    hits = {r.event_key for r in asked.where("b0 AND b1").collect()}
    inside = {r.event_key for r in keys.limit(1500).collect()}
    assert inside <= hits and len(hits - inside) < 60


def test_a_crash_between_two_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    folder, write = str(tmp_path), ledger.Ledger._write
    assert store.append(hours(spark, 1, 50), folder, "s", 0, RULES)

    def dies(self, name, entry, rows):
        if name == "findings":
            raise OSError("killed")
        return write(self, name, entry, rows)

    monkeypatch.setattr(ledger.Ledger, "_write", dies)
    with pytest.raises(OSError):
        store.append(hours(spark, 40, 100), folder, "s", 1, RULES)
    monkeypatch.undo()
    assert counts(spark, folder) == {"events": (50, 50), "findings": (1, 1)}
    lost = ledger.Ledger(spark, folder).recover()
    assert sorted(f.split("/")[0] for f in lost) == ["events", "index"]
    assert store.append(hours(spark, 40, 100), folder, "s", 1, RULES)
    assert not store.append(hours(spark, 40, 100), folder, "s", 1, RULES)
    assert counts(spark, folder) == {"events": (100, 100), "findings": (11, 11)}
    assert ledger.Ledger(spark, folder).recover() == []


def test_a_write_reads_a_flat_number_of_commits(spark, tmp_path):
    folder, read = str(tmp_path), []
    for k in range(12):
        rows = store.keyed(sources.synthetic(spark, 130).where(F.col("ord").between(10 * k, 10 * k + 14)))
        book = ledger.Ledger(spark, folder)
        known = book.known("events", rows.select("event_key", "ts_us"))
        read.append((book.near_last, book.read_last))
        book.commit("s", k, {"events": store.fresh(rows, known, ["event_key"])})
    assert max(near for near, _ in read) <= 2 and max(r for _, r in read) <= 2 and book.read("events").count() == 130 - 1 - 5
    again = store.keyed(sources.synthetic(spark, 130).where("ord = 33"))
    assert book.known("events", again.select("event_key", "ts_us")).join(again, "event_key").count() == 1 and book.read_last == 1
    # The same times with other keys: the bounds leave a commit, the filters none.
    other = again.withColumn("event_key", F.lit("none such"))
    assert book.known("events", other.select("event_key", "ts_us")) is None and (book.near_last, book.read_last) == (1, 0)


def test_compaction_keeps_all_rows_and_batches(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        store.append(hours(spark, 20 * k, 20 * k + 25), folder, "s", k, RULES)
    before = counts(spark, folder)
    book = ledger.Ledger(spark, folder)
    assert book.compact() and not book.compact()
    assert counts(spark, folder) == before and len(book.live("events")) == 1
    assert len(book.recover(replaced=True)) == 12 and counts(spark, folder) == before
    assert not store.append(hours(spark, 0, 25), folder, "s", 0, RULES)
    assert store.append(hours(spark, 0, 200), folder, "s", 3, RULES) and counts(spark, folder)["events"] == (200, 200)


def test_rows_without_a_time_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path)
    untimed = hours(spark, 6, 8).withColumn("ts_us", F.lit(None).cast("long")).withColumn("timestamp", F.lit("bad"))
    for k, rows in enumerate((untimed, untimed.where("false"), untimed.unionByName(hours(spark, 7, 9)), untimed)):
        assert store.append(rows, folder, "s", k, RULES)
    assert counts(spark, folder)["events"] == (6, 6)


def write_lines(folder, name, first, last):
    with open(f"{folder}/{name}.tmp", "w") as file:
        file.writelines(json.dumps({"timestamp": f"2026-01-01T00:{n:02d}:00Z", "host": "h", "source": "s", "event_id": "1", "command_line": f"tool --job {n}"}) + "\n" for n in range(first, last))
    os.rename(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def test_a_stream_that_is_killed_between_its_tables(spark, tmp_path, monkeypatch):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.mkdir(source)
    write_lines(source, "a", 0, 20)
    start = lambda: detection.store_stream(detection.read_stream(spark, source), folder, checkpoint, RULES).trigger(availableNow=True).start()
    start().awaitTermination()
    write_lines(source, "b", 15, 40)
    write = ledger.Ledger._publish
    monkeypatch.setattr(ledger.Ledger, "_publish", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert counts(spark, folder) == {"events": (20, 20), "findings": (1, 1)}
    # Killed after the commit, before the checkpoint knows: the batch comes again and adds nothing.
    monkeypatch.setattr(ledger.Ledger, "_publish", lambda self, entry: (write(self, entry), (_ for _ in ()).throw(OSError("killed"))))
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.undo()
    start().awaitTermination()
    assert counts(spark, folder) == {"events": (40, 40), "findings": (1, 1)}
    entries = ledger.Ledger(spark, folder).entries()
    assert sorted(e["batch"] for e in entries) == [0, 1] and len({e["stream"] for e in entries}) == 1 and all("logOffset" in e["offsets"] for e in entries)
