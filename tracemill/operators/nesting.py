"""Groups that are members of groups: who belongs to which in the end, and what is wrong with such a graph.

All of it goes by rounds over tables that are stored and deleted. A round of the closure joins only what the
round before found, so each link is followed once; there are as many rounds as the deepest nesting. Edges
are (parent, child), null ids are nothing, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, store


def _edges(edges: DataFrame) -> DataFrame:
    return edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()


def memberships(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(member, group) of all groups that hold a member, itself or by a group that they hold. ``direct``: (member, group)."""
    up = store(_edges(edges).select(F.col("child").alias("group"), F.col("parent").alias("above")), "nested")
    fresh = store(direct.where("member IS NOT NULL AND `group` IS NOT NULL").select("member", "group").distinct(), "held")
    found = [fresh]
    while True:
        higher = fresh.join(up, "group").select("member", F.col("above").alias("group")).distinct()
        for known in found:
            higher = higher.join(known, ["member", "group"], "left_anti")
        fresh = store(higher, "held")
        if fresh.isEmpty():
            discard(fresh, up)
            break
        found.append(fresh)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole


def closure(edges: DataFrame) -> DataFrame:
    """(parent, child) of all pairs that a path of edges links."""
    own = _edges(edges)
    return memberships(own.select(F.col("child").alias("member"), F.col("parent").alias("group")), own).select(F.col("group").alias("parent"), F.col("member").alias("child"))


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge into them or out of them are taken away, until there are none: empty without a cycle. Stored."""
    now, n = store(_edges(edges), "core"), -1
    while (left := now.count()) not in (0, n):
        before, now, n = now, store(_peeled(now), "core"), left
        discard(before)
    return now


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges without those at a node that none leads into, or none out of."""
    inside = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    return inside.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")


def _state(now: DataFrame, *more) -> tuple:
    return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "value").cast("decimal(38,0)")), *more).first())


def _settled(start: DataFrame, step, mark: str) -> DataFrame:
    """``step`` applied until the stored table (node, value) is the same twice."""
    now, seen = store(start, mark), None
    while (state := _state(now)) != seen:
        before, now, seen = now, store(step(now), mark), state
        discard(before)
    return now


def _greatest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, value): the greatest value among each node and all that reach it. ``nodes``: (node, value). Stored.

    Nodes that one edge only leads into form lines. By doubling steps each learns the greatest value up to
    the head of its line, which several edges or none lead into; round by round values pass among heads alone.
    """
    links = edges.where("parent <> child")
    into = links.groupBy("child").agg(F.count("*").alias("n"), F.max("parent").alias("to")).where("n = 1")
    lines = store(into.select(F.col("child").alias("node"), "to").join(nodes, "node").select("node", "to", "value", F.lit(False).alias("headed")), "lines")
    seen = None
    # Lines that are closed have no head: their steps go on until no value changes.
    while (state := _state(lines, F.count_if("headed"))) != seen:
        ahead = lines.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("value").alias("above"), F.col("headed").alias("above_headed"))
        met = lines.join(ahead, "to", "left").select(
            "node", F.coalesce("further", "to").alias("to"), F.greatest("value", F.coalesce("above", "value")).alias("value"), (F.col("headed") | F.col("further").isNull() | F.col("above_headed")).alias("headed")
        )
        before, lines, seen = lines, store(met, "lines"), state
        discard(before)
    heads = nodes.join(lines.select("node"), "node", "left_anti")
    onto = links.join(heads.select(F.col("node").alias("child")), "child", "left_semi").join(lines.withColumnRenamed("node", "parent"), "parent", "left")
    onto = store(onto.select(F.when(F.col("to").isNull(), F.col("parent")).when(F.col("headed"), F.col("to")).alias("from"), "child", "value"), "onto")
    begin = heads.unionAll(onto.where("value IS NOT NULL").select("child", "value")).groupBy("node").agg(F.max("value").alias("value"))
    passing = store(onto.where("`from` IS NOT NULL AND `from` <> child").select("from", "child").distinct(), "passing")

    def forward(now: DataFrame) -> DataFrame:
        passed = passing.join(now.withColumnRenamed("node", "from"), "from").select(F.col("child").alias("node"), "value")
        return now.unionAll(passed).groupBy("node").agg(F.max("value").alias("value"))

    top = _settled(begin, forward, "heads")
    ends = lines.join(top.select(F.col("node").alias("to"), F.col("value").alias("above")), "to", "left")
    every = store(top.select("node", "value").unionAll(ends.select("node", F.greatest("value", F.coalesce("above", "value")))), "greatest")
    discard(lines, onto, passing, top)
    return every


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of each node that lies on a cycle; nodes that reach one another have one ``cycle``, the greatest of them.

    Every node takes the greatest value that reaches it, going forward, and then the greatest going back among
    those of its own value. Where both are the same, its nodes reach one another: they are taken out. Others stay tied only
    where both values agree, and go again by other values. Values are hashes anew each time, so that a few rounds do.
    """
    core, found = trimmed(edges), []
    while not core.isEmpty():
        ids = core.select(F.col("parent").alias("node")).unionAll(core.select("child")).distinct()
        nodes = store(ids.select("node", F.struct(F.xxhash64("node", F.lit(len(found))).alias("hash"), F.col("node").alias("id")).alias("value")), "nodes")
        colour = _greatest(core, nodes)
        both = lambda of, edges: edges.join(of.select(F.col("node").alias("parent"), F.col("value").alias("pv")), "parent").join(of.select(F.col("node").alias("child"), F.col("value").alias("cv")), "child").where("pv = cv")
        inner = store(both(colour, core).select("parent", "child", F.col("pv").alias("colour")), "inner")
        back = _greatest(inner.select(F.col("child").alias("parent"), F.col("parent").alias("child")), nodes)
        joined = store(colour.join(back, ["node", "value"], "left_semi"), "connected")
        loops = core.where("parent = child").select(F.col("parent").alias("node")).join(joined, "node")
        several = joined.groupBy("value").agg(F.count("*").alias("n"), F.max("node").alias("cycle"))
        whole = joined.join(several.where("n > 1"), "value").select("node", "cycle").unionAll(loops.select("node", F.col("node").alias("cycle")).join(joined.join(several.where("n = 1"), "value").select("node"), "node", "left_semi"))
        found.append(store(whole, "cycles"))
        rest = store(both(back, inner).where("pv <> colour").select("parent", "child"), "core")
        before, core = core, store(_peeled(rest), "core")
        discard(before, nodes, colour, inner, back, joined, rest)
    if not found:
        return core.select(F.col("parent").alias("node"), F.col("child").alias("cycle"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    return whole


def faults(edges: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(parent, child, fault) of edges to a child that is neither a group nor a member (``dangling``), or both (``ambiguous``), or on a cycle (``cyclic``). Both frames: (id)."""
    own = _edges(edges)
    g, m = (rows.select(F.col("id").alias("child")).where("child IS NOT NULL").distinct() for rows in (groups, members))
    dangling = own.join(g, "child", "left_anti").join(m, "child", "left_anti").select("parent", "child", F.lit("dangling").alias("fault"))
    ambiguous = own.join(g, "child", "left_semi").join(m, "child", "left_semi").select("parent", "child", F.lit("ambiguous").alias("fault"))
    on = store(cycles(own.join(g, "child", "left_semi")), "on-cycles")
    inside = own.join(on.withColumnsRenamed({"node": "parent", "cycle": "pc"}), "parent").join(on.withColumnsRenamed({"node": "child", "cycle": "cc"}), "child").where("pc = cc")
    return dangling.unionAll(ambiguous).unionAll(inside.select("parent", "child", F.lit("cyclic").alias("fault")))


def assignments(members: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """(member, role, organization) of active members whose own and groups' assignments come to exactly one.

    ``members``: (member, active, role, organization), ``held``: of :func:`memberships`, ``groups``: (group, role, organization). Roles
    compare without case and spaces around; an assignment needs both parts.
    """
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    active = members.where("active")
    own = active.select("member", clean("role").alias("role"), F.nullif(F.trim("organization"), F.lit("")).alias("organization"))
    by_group = held.join(groups.select("group", clean("role").alias("role"), F.nullif(F.trim("organization"), F.lit("")).alias("organization")), "group").join(active.select("member"), "member", "left_semi")
    every = own.unionByName(by_group.drop("group")).where("role IS NOT NULL AND organization IS NOT NULL")
    pair = F.struct("role", "organization")
    one = every.groupBy("member").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("low = high")
    return one.select("member", "low.role", "low.organization")
