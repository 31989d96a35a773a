"""Which chains belong together: components of shared hosts, users and sessions, and what they imply.

A chain's scope is a few rows (chain_id, host, user, session), nulls where it names none. Two chains are
related by session and host if both name sessions; else, if either names a user, by user and host; else by
host. Rather than pairs, each shared (host, session), (host, user) or host hangs its chains on one of
them, so a value that a third of all chains share costs as many edges as it has chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text as T

from . import graph
from .correlation import SECOND
from .rules import SEVERITIES

DAY = 86_400 * SECOND
# Techniques that make a remote method a scenario, its severities, and the gap that ends an episode.
METHOD_TECHNIQUES = {"powershell": "T1021.006", "psexec": "T1569.002"}
GRAVE, EPISODE_SECONDS, EPISODE_CONFIDENCE = SEVERITIES[2:], 300, 0.9


def scope_rows(members: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (chain_id, host, user, session) of the events of chains."""
    named = events.select("ord", T.host_name(F.col("host")).alias("host"), F.lower(T.filled(F.col("user"))).alias("user"), F.lower("session").alias("session"))
    filled = members.select("chain_id", "ord").join(named, "ord")
    return filled.select("chain_id", F.nullif("host", F.lit("")).alias("host"), "user", "session").distinct()


def _keys(scopes: DataFrame) -> DataFrame:
    """(chain_id, rule, key, sure): what each chain can be related by; ``sure`` ones relate to all that share the key.

    By session all are sure. By user or host only chains without a session are, as two chains with
    sessions are told apart by those.
    """
    known = scopes.groupBy("chain_id").agg(F.max(F.col("session").isNotNull()).alias("has_session"), F.max(F.col("user").isNotNull()).alias("has_user"))
    part = lambda name: scopes.where(F.col(name).isNotNull()).select("chain_id", name).distinct()
    hosts, users, sessions = part("host"), part("user"), part("session")
    by_session = hosts.join(sessions, "chain_id").select("chain_id", F.lit("session").alias("rule"), F.concat_ws("\0", "host", "session").alias("key"), F.lit(True).alias("sure"))
    by_user = hosts.join(users, "chain_id").join(known, "chain_id").select("chain_id", F.lit("user"), F.concat_ws("\0", "host", "user"), ~F.col("has_session"))
    by_host = hosts.join(known.where("NOT has_user"), "chain_id").select("chain_id", F.lit("host"), "host", ~F.col("has_session"))
    return by_session.unionAll(by_user).unionAll(by_host)


def edges(scopes: DataFrame) -> DataFrame:
    """(a, b) between related chains, enough of them to connect all that are."""
    keys = _keys(scopes)
    hubs = keys.where("sure").groupBy("rule", "key").agg(F.min("chain_id").alias("hub"))
    return keys.join(hubs, ["rule", "key"]).where("chain_id <> hub").select(F.col("chain_id").alias("a"), F.col("hub").alias("b")).distinct()


def components(chains: DataFrame, scopes: DataFrame) -> DataFrame:
    """(chain_id, component). ``chains``: chain_id, start_us, end_us, instance (of a reused session, else null).

    Chains of one lifecycle are a component. Another chain joins the only lifecycle that it is related to and
    overlaps in time; the rest are the connected components of relation, named by their least chain.
    """
    bound = chains.where("instance IS NOT NULL").select("chain_id", F.col("instance").alias("component"))
    days = F.explode(F.sequence(F.floor(F.col("start_us") / DAY), F.floor(F.col("end_us") / DAY))).alias("day")
    keyed = _keys(scopes).join(chains, "chain_id").select("chain_id", "instance", "rule", "key", "sure", "start_us", "end_us", days)
    free, fixed = keyed.where("instance IS NULL"), keyed.where("instance IS NOT NULL")
    side = fixed.select("rule", "key", "day", F.col("instance").alias("owner"), F.col("sure").alias("owner_sure"), F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us"))
    near = free.join(side, ["rule", "key", "day"]).where("(sure OR owner_sure) AND start_us <= to_us AND from_us <= end_us")
    owned = near.groupBy("chain_id").agg(F.min("owner").alias("component"), F.max("owner").alias("last")).where("component = last").select("chain_id", "component")
    settled = graph.cut(bound.unionAll(owned))
    rest = chains.select("chain_id").join(settled, "chain_id", "left_anti")
    tied = graph.components(rest.select(F.col("chain_id").alias("node")), edges(scopes.join(rest, "chain_id", "left_semi")))
    return settled.unionAll(tied.select(F.col("node").alias("chain_id"), "component"))


def namespaces(placed: DataFrame, scopes: DataFrame, chains: DataFrame) -> DataFrame:
    """(component, namespace): 16 digits of a hash over the component's hosts, users, sessions, kinds and members."""
    of = placed.join(scopes, "chain_id")
    part = lambda name: of.where(F.col(name).isNotNull()).select("component", F.concat(F.lit(f"{name}:"), name).alias("part"))
    parts = part("host").unionAll(part("user")).unionAll(part("session"))
    parts = parts.unionAll(placed.join(chains, "chain_id").select("component", F.explode(F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("members:"), "members"))))).distinct()
    digest = F.sum(F.xxhash64("part").cast("decimal(38,0)")).cast("string")
    return parts.groupBy("component").agg(F.substring(F.sha2(F.concat_ws(":", F.count("*"), digest), 256), 1, 16).alias("namespace"))


def findings_of(findings: DataFrame, placed: DataFrame, scopes: DataFrame, members: DataFrame, chains: DataFrame) -> DataFrame:
    """Distinct (component, ord, rule_id): findings that fall to a component.

    A component with a lifecycle takes the findings of its own events only; others take those that share
    session and host, else user and host, else host, by what both sides name. The four are stored before
    they are told apart: if all are dealt by component, Spark 4.1 plans a step above their union without an
    exchange, but may concatenate their partitions when it runs. ``placed`` should be a stored table too.
    """
    strict = placed.join(chains.where("instance IS NOT NULL").select("chain_id"), "chain_id", "left_semi").select("component").distinct()
    own = placed.join(strict, "component", "left_semi").join(members.select("chain_id", "ord"), "chain_id").select("component", "ord").distinct()
    inside = findings.select("ord", "rule_id").join(own, "ord").select("component", "ord", "rule_id")
    loose = graph.cut(placed.join(strict, "component", "left_anti").join(scopes, "chain_id").select("component", "host", "user", "session").distinct())
    named = loose.groupBy("component").agg(F.max(F.col("session").isNotNull()).alias("c_session"), F.max(F.col("user").isNotNull()).alias("c_user"))
    loose = loose.join(named, "component")
    f = findings.select("ord", "rule_id", T.host_name(F.col("host")).alias("host"), F.lower(T.filled(F.col("user"))).alias("f_user"), F.lower("session").alias("f_session"))
    hosts = loose.select("component", "host", "c_session", "c_user").distinct()
    both = lambda name: loose.where(F.col(name).isNotNull()).select("component", name, "c_session", "c_user").distinct().join(hosts.select("component", "host"), "component")
    by_session = f.join(both("session"), ["host"]).where("f_session = session")
    by_user = f.join(both("user"), ["host"]).where("f_user = user AND NOT (f_session IS NOT NULL AND c_session)")
    by_host = f.join(hosts, ["host"]).where("f_user IS NULL AND NOT c_user AND NOT (f_session IS NOT NULL AND c_session)")
    found = [d.select("component", "ord", "rule_id") for d in (inside, by_session, by_user, by_host)]
    return graph.cut(found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])).distinct()


def from_chains(chains: DataFrame, observed: DataFrame) -> DataFrame:
    """Scenarios that a kind of chain alone implies, per component. ``chains``: component, kind; ``observed``: component, techniques."""
    # Kind, scenario, its own technique (only if nothing else was seen, or always), confidence and stage.
    known = (("download_exec", "scenario_chain_download", "T1105", False, 0.6, "execution"), ("encoded_exec", "scenario_chain_encoded", "T1059.001", True, 0.7, "defense_evasion"))
    held = chains.groupBy("component", "kind").agg(F.count("*").alias("n_chains")).join(observed, "component", "left")
    seen = F.coalesce("techniques", F.array().cast("array<string>"))
    rows = []
    for kind, name, own, always, confidence, stage in known:
        all_of = F.array_union(seen, F.array(F.lit(own))) if always else F.when(F.size(seen) == 0, F.array(F.lit(own))).otherwise(seen)
        rows.append(F.when(F.col("kind") == kind, F.struct(F.lit(name).alias("scenario"), F.array_sort(all_of).alias("techniques"), F.lit(confidence).alias("confidence"), F.lit(stage).alias("stage"))))
    return held.select("component", "n_chains", F.inline(F.array_compact(F.array(*rows))))


def grave_matches(matches: DataFrame, events: DataFrame, findings: DataFrame) -> DataFrame:
    """Remote executions whose two hosts both show the method's technique in a grave finding; adds technique."""
    own = F.create_map(*[F.lit(x) for pair in METHOD_TECHNIQUES.items() for x in pair])
    asked = matches.where(F.col("method").isin(*METHOD_TECHNIQUES)).withColumn("technique", own[F.col("method")])
    parts = asked.select("source_ord", "source_host", "target_host", "method", "technique", F.explode(F.concat(F.array("source_ord"), "evidence")).alias("ord"))
    placed = parts.join(events.select("ord", T.host_name(F.col("host")).alias("host")), "ord")
    grave = findings.where(F.lower("severity").isin(*GRAVE)).select("ord", F.upper("technique").alias("seen")).distinct()
    ends = placed.join(grave, (placed["ord"] == grave["ord"]) & (F.col("seen") == F.col("technique")), "left")
    key = ["source_ord", "source_host", "target_host", "method"]
    inner = F.max(~F.col("host").isin(F.col("source_host"), F.col("target_host"))).alias("other_host")
    shown = [F.max((F.col("host") == F.col(h)) & F.col("seen").isNotNull()).alias(f"at_{h}") for h in ("source_host", "target_host")]
    fit = ends.groupBy(*key).agg(inner, *shown).where("NOT other_host AND at_source_host AND at_target_host").select(*key)
    return asked.join(fit, key, "left_semi")


def episodes(grave: DataFrame, seconds: int = EPISODE_SECONDS) -> DataFrame:
    """Scenarios of remote execution: matches of one pair and technique, cut where the next starts so long after the end of the one before.

    ``grave``: with start_us, end_us, confidence.
    """
    line = Window.partitionBy("source_host", "target_host", "technique").orderBy("start_us", "source_ord")
    gap = F.col("start_us") - F.lag("end_us").over(line) > seconds * SECOND
    numbered = grave.withColumn("episode", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(line))
    return numbered.groupBy("source_host", "target_host", "technique", "episode").agg(
        F.count("*").alias("n_chains"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.round(F.least(F.lit(EPISODE_CONFIDENCE), F.avg("confidence")), 6).alias("confidence")
    )


def scenario_ids(found: DataFrame, spaces: DataFrame, name: str = "scenario") -> DataFrame:
    """Adds scenario_id: the component's namespace and the scenario's name, with its place where a name stands twice."""
    joined = found.join(spaces, "component")
    place = F.row_number().over(Window.partitionBy("component", name).orderBy(F.desc("confidence")))
    again = F.when(place > 1, F.concat(place.cast("string"), F.lit("_"))).otherwise(F.lit(""))
    return joined.withColumn("scenario_id", F.concat(F.lit("scope_"), "namespace", F.lit("_"), again, name))

