"""Running values, cuts and as-of joins along one busy key, in blocks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import correlation, graph, logons, protocols, segments, sessions

LEAST = [None, 0]  # all keys in one task each; busy ones in blocks


@pytest.fixture(scope="module")
def timeline():
    """4000 events, nine tenths of them of one host, also at equal instants and without a host."""
    rng = random.Random(5)
    hosts = ["busy"] * 9 + ["h1", None]
    return [(rng.choice(hosts), k, rng.randint(0, 40_000) * 250_000, rng.choice("abcde")) for k in range(4000)]


@pytest.fixture(scope="module")
def events(spark, timeline):
    return spark.createDataFrame(timeline, "host string, ord long, ts_us long, kind string").repartition(5)


def by_host(timeline):
    found = {}
    for row in sorted(timeline, key=lambda r: (r[2], r[1])):
        found.setdefault(row[0], []).append(row)
    return found


@pytest.mark.parametrize("least", LEAST)
def test_gaps(events, timeline, least):
    expected = {}
    for rows in by_host(timeline).values():
        session, before = 0, None
        for _, n, t, _ in rows:
            session += before is None or t - before > 8_000_000
            expected[n], before = session, t
    assert {r.ord: r.session for r in sessions.by_gap(events, "host", 8, least).collect()} == expected
    assert max(expected.values()) > 20


@pytest.mark.parametrize("least", LEAST)
@pytest.mark.parametrize("seconds", [0, 3, 45, 4000, 20_000])
def test_anchors(events, timeline, least, seconds):
    expected = {}
    for rows in by_host(timeline).values():
        anchor = None
        for _, n, t, _ in rows:
            anchor = t if anchor is None or t - anchor > seconds * 1_000_000 else anchor
            expected[n] = anchor
    assert {r.ord: r.anchor_us for r in sessions.from_anchor(events, "host", seconds, least).collect()} == expected


@pytest.mark.parametrize("seed", range(20))
def test_a_block_is_a_function_of_the_anchor(seed):
    rng = np.random.default_rng(seed)
    times, reach = np.sort(rng.integers(1000, 1000 + rng.integers(1, 400), 60)), int(rng.integers(0, 120))
    until, last = segments.anchor_function(times, reach)
    for anchor in range(1000 - reach - 5, int(times[0]) + 1):
        at = np.searchsorted(until, anchor + reach, "right")
        assert (last[at] if at < len(until) else anchor) == segments.greedy(times, reach, anchor)[-1]
    assert len(until) <= len(np.unique(times))


@pytest.mark.parametrize("least", LEAST)
def test_lifecycles_of_a_key(events, timeline, least):
    expected = {}
    for rows in by_host(timeline).values():
        session, inside = 0, False
        for _, n, _, kind in rows:
            session, inside = (session + 1, True) if kind == "a" else (session, inside)
            if inside:
                expected[n] = session
            inside = inside and kind != "b"
    found = sessions.by_lifecycle(events, "host", F.col("kind") == "a", F.col("kind") == "b", least)
    assert {r.ord: r.session for r in found.collect()} == expected


@pytest.mark.parametrize("least", LEAST)
def test_sessions_with_logons(spark, timeline, least):
    ids = {"a": "4624", "b": "4634", "c": "4647", "d": "4688", "e": None}
    rows = [(n, t, h, "u", ids[k], "0x1" if n % 10 else "0x2", f"k{n - n % 50 // 49}") for h, n, t, k in timeline]
    frame = spark.createDataFrame(rows, "ord long, ts_us long, host string, user string, event_id string, session string, key string")
    first, expected, logon_count = {}, {}, {}
    for n, t, h, _, e, s, key in rows:
        if h:
            first[(h, s, key)] = min(first.get((h, s, key), (n, t, e)), (n, t, e), key=lambda r: r[0])
    lines = {}
    for (h, s, key), (n, t, e) in first.items():
        lines.setdefault((h, s), []).append((t, {"4624": 0, "4634": 2}.get(e, 1), key, n, e))
    for line, members in lines.items():
        part, inside = [], False
        logon_count[line] = sum(e == "4624" for *_, e in members)

        def close(part, line=line):
            if len(part) > 1:
                expected.update({n: (line, part[0]) for n in part})

        for _, _, _, n, e in sorted(members):
            if e == "4624":
                close(part)
                part, inside = [n], True
            elif inside:
                part.append(n)
            inside = inside and e != "4634"
        close(part)
    found = logons.lifecycles(frame, least).collect()
    assert sorted(r.ord for r in found) == sorted(expected)
    groups = {}
    for r in found:
        groups.setdefault(r.chain_id, set()).add(expected[r.ord])
        assert r.reused == (logon_count[(r.host_key, r.session)] > 1)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({v for v in expected.values()})


@pytest.mark.parametrize("least", LEAST)
def test_parents_as_of(spark, timeline, least):
    rows = [(n, t, h, f"p{n % 3}" if n % 7 else None, "p1" if n % 5 else None, k if k != "e" else "") for h, n, t, k in timeline]
    frame = spark.createDataFrame(rows, "ord long, ts_us long, host string, own string, made_by string, name string")
    expected, last = {}, {}
    for n, t, h, own, parent, name in sorted(rows):
        seen = last.get((h, parent)) if parent else None
        age = t - seen[0] if seen else None
        expected[n] = (seen[1], age) if seen and 0 <= age <= 2_000_000_000 else (None, None)
        if own and name:
            last[(h, own)] = (t, name)
    found = correlation.as_of_parent(frame, ["host"], "own", "made_by", "name", 2000, least).collect()
    assert {r.ord: (r.parent_name, r.parent_age_us) for r in found} == expected and len(found) == len(rows)
    assert sum(v[0] is not None for v in expected.values()) > 500


@pytest.mark.parametrize("least", LEAST)
def test_windows_of_points(spark, events, timeline, least):
    spans = [(h, k, 400_000_000 * k + 50_000_000, 400_000_000 * k + 200_000_000) for h in ("busy", "h1", "none") for k in range(1, 20)]
    windows = spark.createDataFrame(spans, "host string, window long, start_us long, end_us long")
    nearest, within = {}, {}
    for h, n, t, _ in timeline:
        own = [(k, a, b) for host, k, a, b in spans if host == h]
        nearest[n] = min((max(a - t, t - b, 0) for _, a, b in own), default=None)
        within[n] = next((k for k, a, b in own if a <= t < b), None)
    assert {r.ord: r.distance_us for r in protocols.nearest_window(events, windows, "host", least).collect()} == nearest
    assert {r.ord: r.window for r in protocols.window_of(events, windows, "host", least).collect()} == within
    assert {nearest[n] for h, n, *_ in timeline if h is None} == {None} and any(v == 0 for v in nearest.values())


def test_points_before_all_windows_and_without_any(spark):
    points = spark.createDataFrame([("a", 1, 5), ("a", 2, 100), ("b", 3, 7)], "host string, ord long, ts_us long")
    windows = spark.createDataFrame([("a", 1, 50, 60)], "host string, window long, start_us long, end_us long")
    assert sorted((r.ord, r.distance_us) for r in protocols.nearest_window(points, windows, "host").collect()) == [(1, 45), (2, 40), (3, None)]


def test_a_busy_key_is_spread_evenly(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("busy").alias("host"), F.col("id").alias("ord"), (F.col("id") * 7919 % 100_000).alias("ts_us"))
    plain, busy = segments.split(rows, ["host"], 1000)
    assert plain.count() == 10_000 and {r.host for r in busy.select("host").distinct().collect()} == {"busy"}
    sizes = sorted(r["count"] for r in segments.blocks_of(busy, ["host"], ["ts_us", "ord"]).groupBy("_block").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and sum(sizes) == 90_000


def test_empty_tables(spark, events):
    none = events.where("false")
    for found in (sessions.by_gap(none, "host", 1, 0), sessions.from_anchor(none, "host", 1, 0), sessions.by_lifecycle(none, "host", F.lit(True), F.lit(True), 0)):
        assert found.collect() == []


def test_trails_of_revoked_techniques(spark):
    steps = [(f"T{k}", f"T{k + 1}") for k in range(30)] + [("X1", "X2"), ("X2", "X1"), ("Y", "X1"), ("S", "S")]
    revoked = spark.createDataFrame(steps, "technique string, by string")
    asked = spark.createDataFrame([("T0",), ("T29",), ("T30",), ("X1",), ("Y",), ("S",), ("other",)], "technique string")
    found = {r.technique: r.current for r in protocols.current_technique(asked, revoked).collect()}
    assert found == {"T0": "T30", "T29": "T30", "T30": "T30", "X1": None, "Y": None, "S": "S", "other": "other"}


def test_components_of_a_long_path(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"))
    edges = nodes.where("node % 100 <> 99").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    assert {r.node: r.component for r in graph.components(nodes, edges).collect()} == {k: k - k % 100 for k in range(300)}


def test_remote_evidence_in_blocks_without_pairs(spark):
    """Commands find their evidence along lines of time, also cut in blocks; the only join is that of names of hosts."""
    from tracemill.operators import remote
    from tracemill.plans.log_queries import log

    events = log(spark, "/root/testdata/sf0.001")
    key = lambda r: (r.source_ord, r.target_host, r.method, r.operation, r.service, tuple(r.evidence), r.start_us, r.end_us)
    plain, cut = remote.matches(events), remote.matches(events, least=20)
    assert sorted(map(key, plain.collect())) == sorted(map(key, cut.collect())) != []
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_chains_are_counted_without_pairs(spark):
    """Chains counted along the lines of their keys, also cut in blocks, are those of all pairs."""
    from tracemill.plans import engine, queries

    events = queries.events(spark, "/root/testdata/sf0.001")
    findings, links = queries.found(spark, "/root/testdata/sf0.001"), (*queries.LINKS, engine.Link("again", "view", "view", 7200, ("host",)), engine.Link("any", "signup", "error", 600, ()))
    cut = engine.correlate(events, findings, links, least=20)
    sizes = {(r.kind, r.a_ord): (r.n_events, r.span_us) for r in cut.collect()}
    expected = {}
    for link in links:
        pairs = correlation.interval_join(events.where(F.col("source") == link.first), events.where(F.col("source") == link.second), link.keys, link.seconds)
        expected |= {(link.kind, r.a_ord): (r.n_events, r.span_us) for r in correlation.chains(pairs).collect()}
    assert sizes == expected != {}
