"""Remote execution: commands that name another host, joined in time with what that host recorded.

Expects events with the columns of :func:`evidence_columns`; ``host`` is compared without case and
trailing dots. Commands and what hosts recorded lie on lines of time by host, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T

from . import tables
from .segments import SECOND, Fold, Line

# Which events tell a remote command, how targets are written in it, and the reach of each kind of evidence.
SOURCE_IDS, SERVICE_IDS, PROCESS_IDS, LOGON_ID, NETWORK_LOGON = ("1", "4104", "4688"), ("7045", "4697"), ("1", "4688"), "4624", "3"
BACK, AHEAD, DEFINED_BACK = 5, 120, 1800
REMOTE_SHELL = r"(?i)\b(?:invoke-command|enter-pssession|new-pssession)\b"
COMPUTER = r"(?i)-computername\s+(?:['\"])?([A-Za-z0-9_.-]+)"
PSEXEC = r"(?i)\bpsexec(?:64)?(?:\.exe)?\b[^\r\n]*?\\\\([A-Za-z0-9_.-]+)"
CONTROL = r"""(?i)\bsc(?:\.exe)?\b["]?\s+\\\\([A-Za-z0-9_.-]+)\s+(create|start)\s+(?:"([^"\r\n]+)"|([^\s"]+))"""


def targets(texts: Column) -> Column:
    """Array of (method, token, operation, service) that an array of texts names, each once."""
    none = F.lit("")

    def one(text: Column) -> Column:
        pick = lambda pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
        made = lambda method, token, operation=none, service=none: F.struct(F.lit(method).alias("method"), token.alias("token"), operation.alias("operation"), service.alias("service"))
        shell = F.when(text.rlike(REMOTE_SHELL), F.transform(pick(COMPUTER, 1), lambda t: made("powershell", t))).otherwise(F.array().cast("array<struct<method:string,token:string,operation:string,service:string>>"))
        control = F.transform(F.arrays_zip(*[pick(CONTROL, k).alias(f"g{k}") for k in (1, 2, 3, 4)]), lambda g: made("scm", g["g1"], F.lower(g["g2"]), F.concat(g["g3"], g["g4"])))
        return F.concat(shell, F.transform(pick(PSEXEC, 1), lambda t: made("psexec", t)), control)

    return F.array_distinct(F.flatten(F.transform(texts, one)))


def aliases(events: DataFrame) -> DataFrame:
    """(alias, target_host): full and short names that mean one host only."""
    hosts = events.select(T.host_name(F.col("host")).alias("host")).where("host <> ''").distinct()
    named = hosts.select("host", F.explode(F.array_distinct(F.array("host", T.short_host(F.col("host"))))).alias("alias"))
    return named.groupBy("alias").agg(F.min("host").alias("target_host"), F.max("host").alias("last")).where("target_host = last").drop("last")


_COMMAND = ("ord", "ts_us", "source_host", "account", "target_host", "method", "operation", "service")


def _answered(asks: DataFrame, evidence: DataFrame, least: int | None) -> DataFrame:
    """Asks (command, kind, value) with ``found`` (ts_us, ord, file): the first evidence of their kind and value on their target in reach, the last for ``defined``.

    Asks and evidence (host, kind, value, seen) lie on one line of time by host, kind and value, so work grows with
    their number and not with their pairs, however many meet in a moment.
    """
    key = lambda host: F.concat_ws("\0", host, "kind", "value").alias("key")
    at = F.when(F.col("kind") == "defined", F.col("ts_us") + BACK * SECOND).otherwise(F.col("ts_us") - BACK * SECOND)
    side = F.when(F.col("kind") == "defined", 2).otherwise(0)
    none = lambda frame, name: F.lit(None).cast(frame.schema[name].dataType).alias(name)
    asked = asks.select(key("target_host"), at.alias("at_us"), side.alias("side"), F.lit(None).cast("long").alias("place"), none(evidence, "seen"), F.struct(*_COMMAND, "kind").alias("asked"))
    given = evidence.select(key("host"), F.col("seen.ts_us").alias("at_us"), F.lit(1).alias("side"), F.col("seen.ord").alias("place"), "seen", none(asked, "asked"))
    line = Line(asked.unionByName(given), ["key"], ["at_us", "side", "place"], least).fold(after=Fold("first", F.col("seen"), own=False), before=Fold("last", F.col("seen"), own=False))
    held = line.rows().where("asked IS NOT NULL").select("asked.*", "after", "before")
    last = F.when(F.col("before.ts_us") >= F.col("ts_us") - DEFINED_BACK * SECOND, F.col("before"))
    first = F.when(F.col("after.ts_us") <= F.col("ts_us") + AHEAD * SECOND, F.col("after"))
    return held.select(*_COMMAND, "kind", F.when(F.col("kind") == "defined", last).otherwise(first).alias("found")).where("found IS NOT NULL")


def matches(events: DataFrame, least: int | None = None) -> DataFrame:
    """Remote executions with their evidence.

    ``events``: ord, ts_us, host, event_id, user, and from the record logon_type, target_user, service,
    service_file, image, texts (array of commands and scripts). Returns source_ord, source_host,
    target_host, method, operation, service, evidence (array of ord), start_us and end_us. Of commands with
    the same evidence for the same operation the earliest stays.
    """
    e = events.where("ts_us IS NOT NULL").withColumn("host", T.host_name(F.col("host"))).where("host <> ''")
    account = F.when(F.col("event_id") == LOGON_ID, F.coalesce(T.filled(F.col("target_user")), F.col("user"))).otherwise(F.coalesce(T.filled(F.col("user")), F.col("target_user")))
    e = e.withColumn("account", F.coalesce(T.account_leaf(account), F.lit("")))
    named = e.where(F.col("event_id").isin(*SOURCE_IDS)).select("ord", "ts_us", F.col("host").alias("source_host"), "account", F.explode(targets(F.col("texts"))).alias("t")).select("ord", "ts_us", "source_host", "account", "t.*")
    alias = F.lower(F.regexp_replace("token", r"\.+$", ""))
    resolved = named.join(aliases(events), alias == F.col("alias")).where("target_host <> source_host").withColumn("service", T.service_name(F.col("service")))
    commands = resolved.select(*_COMMAND).distinct()

    has = lambda word: F.exists(F.concat("texts", F.array(F.coalesce("image", F.lit("")))), lambda t: F.lower(t).contains(word))
    of = lambda kind, value="": F.struct(F.lit(kind).alias("kind"), (F.lit(value) if value == "" else F.col(value)).alias("value"))
    several = lambda **kinds: F.array_compact(F.array(*[F.when(holds, of(kind, value)) for kind, (holds, value) in kinds.items()]))
    # An account is equal, or unknown on one side.
    process, installs, unknown = F.col("event_id").isin(*PROCESS_IDS), F.col("event_id").isin(*SERVICE_IDS), F.col("account") == ""
    logon = (F.col("event_id") == LOGON_ID) & (F.col("logon_type") == NETWORK_LOGON)
    named_service = installs & (F.col("name") != "")
    seen = F.struct("ts_us", "ord", F.col("service_file").alias("file")).alias("seen")
    kinds = several(
        logon=(logon & ~unknown, "account"), logon_unknown=(logon & unknown, ""), logon_any=(logon, ""), shell=(process & has("wsmprovhost.exe"), ""), process_seen=(process & has("psexesvc"), ""),
        service_seen=(installs & F.lower(F.concat_ws("\0", "service", "service_file")).contains("psexesvc"), ""), created=(named_service, "name"), defined=(named_service & (F.col("service_file") != ""), "name"),
    )
    evidence = e.withColumn("name", T.service_name(F.col("service"))).select("host", seen, F.inline(kinds))
    remote, scm = F.col("method").isin("powershell", "psexec"), F.col("method") == "scm"
    psexec = F.col("method") == "psexec"
    wanted = several(
        logon=(remote & ~unknown, "account"), logon_unknown=(remote & ~unknown, ""), logon_any=(remote & unknown, ""), shell=(F.col("method") == "powershell", ""), process_seen=(psexec, ""), service_seen=(psexec, ""),
        created=(scm & (F.col("operation") == "create"), "service"), defined=(scm & (F.col("operation") == "start"), "service"),
    )
    answered = tables.store(_answered(commands.select("*", F.inline(wanted)), evidence, least), "answered")
    start = answered.where("kind = 'defined'").select(*_COMMAND, F.lit("started").alias("kind"), T.command_text(F.col("found.file")).alias("value")).where("value <> ''")
    run = e.where(process).select("host", F.lit("started").alias("kind"), F.explode(F.transform("texts", T.command_text)).alias("value"), seen).select("host", "seen", "kind", "value")
    both = answered.where("kind <> 'defined'").unionByName(_answered(start, run, least))
    parts = ("logon", "shell", "service_seen", "process_seen", "created", "started")
    joined = both.groupBy(*_COMMAND).agg(*[F.min(F.when(F.col("kind").startswith(p), F.col("found"))).alias(p) for p in parts])
    proven = (
        F.when(F.col("method") == "powershell", F.col("logon").isNotNull() & F.col("shell").isNotNull())
        .when(F.col("method") == "psexec", F.col("logon").isNotNull() & (F.col("service_seen").isNotNull() | F.col("process_seen").isNotNull()))
        .otherwise(F.col("created").isNotNull() | F.col("started").isNotNull())
    )
    evidence = F.array_compact(F.array(*[F.col(f"{p}.ord") for p in parts]))
    times = F.array_compact(F.array("ts_us", *[F.col(f"{p}.ts_us") for p in parts]))
    shaped = joined.where(proven).select(F.col("ord").alias("source_ord"), "ts_us", "source_host", "target_host", "method", "operation", "service", evidence.alias("evidence"), F.array_min(times).alias("start_us"), F.array_max(times).alias("end_us"))
    same = ("source_host", "target_host", "method", "operation", "service", "evidence")
    first = F.min(F.struct("ts_us", "source_ord", "start_us", "end_us")).alias("first")
    return shaped.groupBy(*same).agg(first).select("first.source_ord", *same, "first.start_us", "first.end_us")


def chain_id() -> Column:
    return F.concat_ws("_", F.lit("remote_execution"), "source_ord", "target_host", "method", "operation", "service")


def members(found: DataFrame) -> DataFrame:
    """(kind, chain_id, ord) of the source and the evidence of each match."""
    return found.select(F.lit("remote_execution").alias("kind"), chain_id().alias("chain_id"), F.explode(F.array_distinct(F.concat(F.array("source_ord"), "evidence"))).alias("ord"))
