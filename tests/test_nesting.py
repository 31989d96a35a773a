"""Nested groups against recursive searches."""

import random

import pytest

from tracemill.operators import nesting


def reach(edges, start):
    seen, left = set(), [c for p, c in edges if p == start]
    while left:
        n = left.pop()
        if n not in seen:
            seen.add(n)
            left += [c for p, c in edges if p == n]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)] + [(3, 3), (40, 41), (41, 42), (42, 40), (42, 50), (50, 51), (51, 50)]
    frame = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "parent long, child long")
    paths = {p: reach(edges, p) for p in {n for e in edges for n in e}}
    assert {tuple(r) for r in nesting.closure(frame).collect()} == {(p, c) for p, cs in paths.items() for c in cs}
    on = {p: max(c for c in cs if p in paths[c]) for p, cs in paths.items() if p in cs}
    found = [tuple(r) for r in nesting.cycles(frame).collect()]
    assert dict(found) == on and len(found) == len(on)


def test_no_cycles_and_no_edges(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(12)], "parent long, child long")
    assert nesting.cycles(path).collect() == [] and nesting.cycles(path.where("false")).collect() == [] and nesting.closure(path.where("false")).collect() == []
    assert nesting.closure(path).count() == 12 * 13 // 2


def test_faults_and_assignments(spark):
    edges = spark.createDataFrame([("g1", "g2"), ("g2", "g3"), ("g3", "g2"), ("g1", "u1"), ("g3", "u2"), ("g1", "gone"), ("g3", "both")], "parent string, child string")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    found = {tuple(r) for r in nesting.faults(edges, ids("g1", "g2", "g3", "both"), ids("u1", "u2", "both", None)).collect()}
    assert found == {("g1", "gone", "dangling"), ("g3", "both", "ambiguous"), ("g2", "g3", "cyclic"), ("g3", "g2", "cyclic")}
    held = nesting.memberships(spark.createDataFrame([("u1", "g1"), ("u2", "g3"), ("u3", "g3"), ("u4", "g3"), (None, "g1")], "member string, group string"), edges)
    assert {(r.member, r.group) for r in held.collect()} == {("u1", "g1"), *((u, g) for u in ("u2", "u3", "u4") for g in ("g1", "g2", "g3"))}
    members = spark.createDataFrame([("u1", True, " Admin ", "o1"), ("u2", True, None, None), ("u3", True, "viewer", "o2"), ("u4", False, None, None), ("u5", True, "viewer", "")], "member string, active boolean, role string, organization string")
    groups = spark.createDataFrame([("g1", "admin", "o1"), ("g2", "", "o1"), ("g3", "ADMIN", "o1")], "group string, role string, organization string")
    assert sorted(map(tuple, nesting.assignments(members, held, groups).collect())) == [("u1", "admin", "o1"), ("u2", "admin", "o1")]


def test_cycles_of_long_lines_take_few_rounds(spark, monkeypatch):
    """Rings, a closed line with a tail, and rings tied one way: rounds grow with the logarithm of a line, not with its length."""
    ring = lambda *ids: list(zip(ids, (*ids[1:], ids[0])))
    edges = [*ring(*range(100)), *ring(*range(200, 260)), (5, 210), (99, 300), (300, 301), (301, 302), (302, 301), *ring(400, 401), (250, 400), (500, 500), (401, 500)]
    frame = spark.createDataFrame(edges, "parent long, child long")
    written = []
    monkeypatch.setattr(nesting, "store", lambda df, name, store=nesting.store: written.append(name) or store(df, name))
    found = {(r.node, r.cycle) for r in nesting.cycles(frame).collect()}
    assert found == {*((k, 99) for k in range(100)), *((k, 259) for k in range(200, 260)), (301, 302), (302, 302), (400, 401), (401, 401), (500, 500)}
    assert len(written) < 150
