"""Chains of logon sessions and of activity between them.

A chain is kept as its members (kind, chain_id, ord, ts_us), one row each, and as one summary row with a
digest of its members, so a chain of any length is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T

from . import sessions, tables
from .correlation import SECOND, chain_confidence, severity_weight
from .segments import Fold, Line

# Event ids of logons, and their order at the same instant.
LOGON, INITIATED_LOGOFF, LOGOFF, FAILED = "4624", "4647", "4634", "4625"
AUTHENTICATION = (LOGON, INITIATED_LOGOFF, LOGOFF, FAILED)
SESSION_CONFIDENCE, ACTIVITY_SECONDS = 0.7, 1800


def explicit_session(event_id: str = "event_id", target: str = "target_logon_id", other: str = "session_id"):
    """The session that a logon event names: the target's id where the field is there, even if it is none; else the general one."""
    e = F.col(event_id)
    general = F.when(e.isin(LOGON, LOGOFF), T.session_id(F.col(other)))
    return F.when(e.isin(LOGON, LOGOFF, INITIATED_LOGOFF) & F.col(target).isNotNull(), T.session_id(F.col(target))).otherwise(general)


def summary(members: DataFrame, *keys: str) -> DataFrame:
    """One row per chain: size, first and last instant, and a digest that equal sets of events share."""
    digest = F.concat_ws(":", F.count("*"), F.min("ord"), F.max("ord"), F.sum(F.xxhash64("ord").cast("decimal(38,0)")))
    return members.groupBy("kind", "chain_id", *keys).agg(F.count("*").alias("n_events"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), digest.alias("members"))


def lifecycles(events: DataFrame, least: int | None = None) -> DataFrame:
    """Members of session chains from events with ``session``: cut at each logon, closed by a logoff, of two events at least.

    Repeated events (the same ``key``) count once. Adds host_key, reused (the host's id serves several
    lifecycles) and the chain's id, which for a reused one carries a token of its first event's key. All follows
    from running values along a session, so one that has a large part of all events is cut in blocks.
    """
    own = events.where("session IS NOT NULL AND ts_us IS NOT NULL").withColumn("host_key", F.lower(F.trim("host"))).where("host_key <> ''")
    first = own.groupBy("host_key", "session", "key").agg(F.min(F.struct("ord", "ts_us", "event_id", "host", "user")).alias("e")).select("host_key", "session", "key", "e.*")
    at = F.coalesce("event_id", F.lit(""))
    logon, mark = at == LOGON, F.when(at == LOGOFF, False).when(at == LOGON, True)
    ranked = first.select("host_key", "session", "key", "ord", "ts_us", "event_id", F.when(logon, 0).when(at == LOGOFF, 2).otherwise(1).alias("rank"))
    # A line counts its rows by key, and deals and reads them again: they are worked out once.
    line = Line(tables.store(ranked, "logons"), ["host_key", "session"], ["ts_us", "rank", "key"], least).fold(
        open=Fold("last", mark, own=False), start_key=Fold("last", F.when(logon, F.col("key"))), then=Fold("first", at, own=False), logons=Fold("total", logon.cast("long"))
    )
    # After a logon the next event, unless it is one as well, is of the same lifecycle.
    kept = line.rows().where((logon & (F.col("then") != LOGON)) | (~logon & F.col("open")))
    base = F.concat_ws("_", F.lit("session"), "host_key", "session")
    named = F.when(F.col("logons") > 1, F.concat_ws("_", base, F.substring(F.sha2("start_key", 256), 1, 10))).otherwise(base)
    return kept.select(F.lit("session").alias("kind"), named.alias("chain_id"), (F.col("logons") > 1).alias("reused"), "host_key", "session", "ord", "ts_us")


def session_chains(events: DataFrame) -> DataFrame:
    found = summary(lifecycles(events), "host_key", "session", "reused")
    return found.withColumn("instance", F.when(F.col("reused"), F.col("chain_id"))).withColumn("confidence", F.lit(SESSION_CONFIDENCE))


def activities(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Members of activity chains: events with findings, outside sessions and logons, of one host and user, within half an hour of the first."""
    bare = events.where("session IS NULL AND ts_us IS NOT NULL").where(~F.col("event_id").isin(*AUTHENTICATION))
    named = bare.withColumn("host_key", F.lower(F.trim("host"))).withColumn("user_key", F.lower(F.trim("user"))).where("host_key <> '' AND user_key <> ''")
    seen = named.join(findings.select("ord").distinct(), "ord", "left_semi").withColumn("scope", F.concat_ws("\0", "host_key", "user_key"))
    # Both are read several times, by the counts of keys and of chains too.
    own = tables.store(seen.select("scope", "ord", "ts_us"), "activity")
    anchored = tables.store(sessions.from_anchor(own, "scope", ACTIVITY_SECONDS), "activity")
    tables.discard(own)
    several = anchored.groupBy("scope", "anchor_us").agg(F.count("*").alias("n")).where("n > 1")
    host, user = F.split("scope", "\0")[0], F.split("scope", "\0")[1]
    chain = F.concat_ws("_", F.lit("activity"), host, user, "anchor_us")
    return anchored.join(several, ["scope", "anchor_us"]).select(F.lit("activity").alias("kind"), chain.alias("chain_id"), host.alias("host_key"), user.alias("user_key"), "ord", "ts_us")


def with_confidence(members: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Summaries of chains with n_findings and the confidence that their span, size and findings give."""
    weights = findings.groupBy("ord").agg(F.sum(severity_weight(F.col("severity"))).alias("w"), F.count("*").alias("f"))
    weighed = members.join(weights, "ord", "left").groupBy("kind", "chain_id").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_findings"))
    both = summary(members, *keys).join(weighed, ["kind", "chain_id"])
    sure = chain_confidence(F.col("n_events"), F.col("end_us") - F.col("start_us"), F.col("w"), F.col("n_findings"))
    return both.withColumn("confidence", F.round(sure, 6)).drop("w")


def distinct_chains(chains: DataFrame) -> DataFrame:
    """Of chains with the same kind and members the surest one, by id at a tie."""
    best = F.min(F.struct((-F.col("confidence")).alias("down"), "chain_id", *[c for c in chains.columns if c not in ("kind", "members", "chain_id")])).alias("b")
    return chains.groupBy("kind", "members").agg(best).select("kind", "members", "b.*").drop("down").select(*chains.columns)


__all__ = ["ACTIVITY_SECONDS", "SECOND", "activities", "distinct_chains", "explicit_session", "lifecycles", "session_chains", "summary", "with_confidence"]
