"""Components kept up to date and streams of labels, against the same worked out at once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import evaluation, graph, growing, ledger, store
from tracemill.operators.rules import Rule
from tracemill.sources import events as sources
from tracemill.streaming import detection
from tracemill.streaming import evaluation as scoring


def test_components_of_ten_batches(spark, tmp_path):
    rng, nodes, edges = random.Random(3), [], []
    kept = growing.Components(ledger.Ledger(spark, str(tmp_path)))
    for k in range(10):
        new = [(n,) for n in range(40 * k, 40 * k + 40)]
        # Most edges stay among new nodes; a few tie them to what is there, and the last batches tie large parts.
        ties = [(rng.randrange(40 * k, 40 * k + 40), rng.randrange(40 * k, 40 * k + 40)) for _ in range(22)] + [(rng.randrange(40 * k + 40), rng.randrange(40 * k + 40)) for _ in range(3)]
        ties += [(7, None), (5, 5), ties[0]]
        nodes, edges = nodes + new, edges + ties
        assert kept.add(spark.createDataFrame(new, "node long"), spark.createDataFrame(ties, "a long, b long"), "s", k)
        assert kept.rewritten("s", k) <= 40 + 2 * 60
        if k in (0, 4, 9):
            whole = graph.components(spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long").where("a IS NOT NULL AND b IS NOT NULL"))
            assert {r.node: r.component for r in kept.labels().collect()} == {r.node: r.component for r in whole.collect()}
    assert not kept.add(spark.createDataFrame(new, "node long"), spark.createDataFrame([(0, 399)], "a long, b long"), "s", 9)
    assert kept.add(spark.createDataFrame([], "node long"), spark.createDataFrame([], "a long, b long"), "s", 10) and kept.rewritten("s", 10) == 0


def test_text_nodes_join_the_larger_side(spark, tmp_path):
    kept = growing.Components(ledger.Ledger(spark, str(tmp_path)), "string")
    chain = spark.createDataFrame([(f"m{k:03d}", f"m{k + 1:03d}") for k in range(100)], "a string, b string")
    assert kept.add(spark.createDataFrame([("z",)], "node string"), chain, "s", 0)
    assert kept.add(spark.createDataFrame([], "node string"), spark.createDataFrame([("z", "m050"), ("a", "z")], "a string, b string"), "s", 1)
    assert kept.rewritten("s", 1) <= 4
    assert {r.component for r in kept.labels().collect()} == {"a"} and kept.labels().count() == 103


RULES = [Rule("S", "sevens", "command_line", "job 7", "contains", technique="t1059"), Rule("T", "ends in 9", "command_line", "9", "endswith")]


def row(n, **more):
    return {"timestamp": f"2026-01-01T{n // 60:02d}:{n % 60:02d}:00Z", "host": "h", "source": f"s{n % 3}", "event_id": "1", "command_line": f"tool --job {n}"} | more


@pytest.fixture(scope="module")
def inputs(spark):
    events = [row(n) for n in range(200) if n % 11] + [row(n) for n in (31, 32)]
    keyed = store.keyed(sources.from_json_lines(spark.createDataFrame([(k, json.dumps(row(n))) for k, n in enumerate(range(230))], "ord long, value string"))).orderBy("ord").collect()
    labels = [{"event_key": r.event_key, "ts_us": r.ts_us, "label": ("malicious", "benign", "benign", "ignore")[k % 4]} for k, r in enumerate(keyed) if k % 13]
    return events, labels


def put(folder, name, rows):
    with open(f"{folder}/{name}.tmp", "w") as file:
        file.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def test_streams_of_events_and_labels(spark, tmp_path, inputs, monkeypatch):
    events, labels = inputs
    said, seen, folder, checkpoint = (str(tmp_path / n) for n in ("labels", "events", "out", "check"))
    os.mkdir(said), os.mkdir(seen)
    # Labels come before and after their events; one batch is killed before its commit.
    for k, (a, b) in enumerate((((0, 80), (0, 30)), ((80, 130), (30, 150)), ((130, 500), (150, 500)))):
        put(seen, f"e{k}", sorted(events[slice(*a)], key=lambda r: hash(r["timestamp"]) % 7))
        put(said, f"l{k}", labels[slice(*b)])
        query = lambda: scoring.score_stream(detection.read_stream(spark, seen), scoring.read_labels(spark, said), RULES, folder, checkpoint, "3 hours").trigger(availableNow=True).start()
        if k == 1:
            monkeypatch.setattr(ledger.Ledger, "_publish", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(Exception, match="killed"):
                query().awaitTermination()
            monkeypatch.undo()
        query().awaitTermination()
    put(seen, "end", [row(0, timestamp="2026-02-01T00:00:00Z", event_id="heartbeat")])
    put(said, "end", [{"event_key": None, "ts_us": 1769904000000000, "label": None}])
    query().awaitTermination()

    batch = store.keyed(sources.from_json_lines(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(events[:-2])], "ord long, value string")))
    wanted = spark.createDataFrame([(r["event_key"], r["label"]) for r in labels], "event_key string, label string")
    hit = F.contains("command_line", F.lit("job 7")) | F.endswith("command_line", F.lit("9"))
    both = batch.join(wanted, "event_key").where("label <> 'ignore'").select((F.col("label") == "malicious").alias("malicious"), hit.alias("flagged"))
    expected = evaluation.confusion(both).first()
    gaps = {r.gap: r["count"] for r in evaluation.label_gaps(batch, wanted, "event_key").groupBy("gap").count().collect()}
    found = scoring.totals(spark, folder).first()
    assert (found.tp, found.fn, found.fp, found.tn, found.precision, found.recall, found.fpr) == (expected.tp, expected.fn, expected.fp, expected.tn, expected.precision, expected.recall, expected.fpr)
    assert {"unlabelled": found.unlabelled, "unknown": found.unknown} == gaps and min(gaps.values()) > 5 and found.tp and found.fp and found.flagged_ignored
    rows = ledger.Ledger(spark, folder).read("scored")
    assert rows.count() == rows.select("event_key").distinct().count()
    assert {tuple(r.techniques) for r in rows.where("flagged").collect()} == {("T1059",), ()}


def test_components_hold_customers_only(spark, tmp_path):
    """A link over a number that is no customer's joins customers, but the number gets no row."""
    from tracemill.plans import queries, report_queries  # noqa: F401

    spark.createDataFrame([(0,), (1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(37 * 5, 0), (37 * 8, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, queries.QUERIES["growing_components"](spark, str(tmp_path)).collect())) == [(0, 0), (1, 0), (2, 2)]
