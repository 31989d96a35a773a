"""Event sources: JSON Lines records, the driver's ``events`` table and a synthetic generator, in one schema.

Every source gives the columns of ``COLUMNS``: the order of input, the instant in microseconds (null where
it can't be read), the text fields that rules look at, and the whole record as JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("ord", "ts_us", "timestamp", "host", "source", "event_id", "level", "user", "command_line", "raw")

# Names under which records carry a field, the preferred one first.
HOST_NAMES = ("computer_name", "Hostname", "Computer")
SOURCE_NAMES = ("source_name", "SourceName", "source", "provider", "ProviderName")
TIME_NAMES = ("timestamp", "@timestamp", "UtcTime", "EventTime", "time_created", "TimeCreated")
ID_NAMES = ("event_id", "EventID", "eventid", "eid")
USER_NAMES = ("user", "User", "account")
DATA_USER_NAMES = ("User", "SubjectUserName", "TargetUserName", "AccountName", "UserName")
COMMAND_NAMES = ("command_line", "CommandLine", "ProcessCommandLine", "cmdline")
LEVEL_NAMES = ("level", "severity")

_MAP = "map<string,string>"


def lookup(entries: Column, *names: str) -> Column:
    """The first value that is neither null nor empty under one of ``names``, whatever their case."""

    def one(name: str) -> Column:
        held = F.filter(F.map_entries(entries), lambda e: (F.lower(e["key"]) == name.lower()) & (e["value"] != ""))
        return F.get(held, F.lit(0))["value"]

    return F.coalesce(*[one(name) for name in names])


def _scalar(value: Column, join_domain: bool, *names: str) -> Column:
    """A text as it is; of an object, the field that names it (with its domain, for users)."""
    inner = F.when(value.startswith("{"), F.from_json(value, _MAP))
    name = lookup(inner, *names)
    if join_domain:
        name = F.coalesce(F.concat_ws("\\", lookup(inner, "domain"), lookup(inner, "name", "username")), F.lit(""))
        name = F.when(lookup(inner, "name", "username").isNotNull(), name).otherwise(lookup(inner, "id", "identifier"))
    return F.when(value.startswith("{"), name).otherwise(value)


def instant(text: Column) -> Column:
    """Microseconds of an ISO text, without zone taken as UTC; null if it isn't one."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    iso = text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?$")
    return F.unix_micros(F.when(iso, F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))).try_cast("timestamp"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Events of the JSON objects in column ``value``, ordered by column ``ord``; other lines are left out."""
    entries = F.from_json("value", _MAP)
    read = lines.where(F.trim("value").startswith("{")).select("ord", F.col("value").alias("raw"), entries.alias("m")).where(F.size("m") > 0)
    data = F.from_json(lookup(F.col("m"), "event_data"), _MAP)
    read = read.select("*", data.alias("d"))
    m, d = F.col("m"), F.col("d")
    host = F.coalesce(lookup(m, *HOST_NAMES), _scalar(lookup(m, "host", "computer"), False, "name", "hostname", "computer_name"), F.lit("unknown"))
    source = F.coalesce(_scalar(lookup(m, *SOURCE_NAMES), False, "name", "provider"), F.lit("unknown"))
    user = F.coalesce(_scalar(lookup(m, *USER_NAMES), True), lookup(d, *DATA_USER_NAMES), F.lit(""))
    time = F.coalesce(lookup(m, *TIME_NAMES), F.lit(""))
    return read.select(
        "ord", instant(F.trim(time)).alias("ts_us"), time.alias("timestamp"), host.alias("host"), source.alias("source"),
        F.coalesce(lookup(m, *ID_NAMES), F.lit("")).alias("event_id"), F.coalesce(lookup(m, *LEVEL_NAMES), F.lit("")).alias("level"), user.alias("user"),
        F.coalesce(lookup(m, *COMMAND_NAMES), lookup(d, *COMMAND_NAMES)).alias("command_line"), "raw",
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of all JSON Lines files under ``path``, numbered by path, block and line.

    Blocks are numbered first, in one row each, so ``ord`` doesn't depend on how Spark packs files into tasks.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    at = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    blocks = at.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    begin = F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = blocks.select("path", "block", "first", F.coalesce(begin, F.lit(0)).alias("begin"))
    # A block's lines are numbered in a row by the scan, so the distance to its first one is the place in it.
    joined = at.join(numbered, ["path", "block"])
    return from_json_lines(joined.select("value", (F.col("begin") + F.col("line") - F.col("first")).alias("ord")))


def from_table(events: DataFrame) -> DataFrame:
    """The driver's ``events`` table as events: event types are sources, properties are command lines."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").alias("ord"), micros.alias("ts_us"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("event_id"),
        F.lit("").alias("level"), F.concat(F.lit("u"), F.col("user_id")).alias("user"), F.col("props").alias("command_line"), F.col("props").alias("raw"),
    )


def synthetic(spark: SparkSession, rows: int) -> DataFrame:
    """Process creations one second apart on 16 hosts by 32 users; every thousandth is suspicious."""
    n = F.col("id")
    suspicious = n % 1000 == 0
    command = F.when(suspicious, F.lit("powershell.exe -enc SQBFAFgA")).otherwise(F.concat(F.lit("tool.exe --job "), n))
    micros = F.lit(1767225600000000) + n * 1000000
    return spark.range(1, rows + 1).select(
        n.alias("ord"), micros.alias("ts_us"), F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.format_string("BENCH-%02d", n % 16).alias("host"), F.lit("Sysmon").alias("source"), F.lit("1").alias("event_id"), F.lit("").alias("level"),
        F.format_string("LAB\\bench%02d", n % 32).alias("user"), command.alias("command_line"), F.to_json(F.struct(n.alias("sequence"))).alias("raw"),
    )


def normalise(events: DataFrame) -> DataFrame:
    """First record of each strong Windows identity (channel and record number), and all events without one."""
    entries = F.from_json("raw", _MAP)
    system = F.from_json(lookup(entries, "System"), _MAP)
    channel = lookup(F.when(system.isNotNull(), system).otherwise(entries), "Channel")
    record = lookup(F.when(system.isNotNull(), system).otherwise(entries), "EventRecordID")
    keyed = events.select(*COLUMNS, channel.alias("channel"), record.alias("record_id"))
    strong = keyed.where("channel IS NOT NULL AND record_id IS NOT NULL")
    weak = keyed.where("channel IS NULL OR record_id IS NULL").select(*COLUMNS)
    key = ["timestamp", "host", "source", "event_id", "channel", "record_id"]
    first = strong.groupBy(*key).agg(F.min_by(F.struct(*COLUMNS), "ord").alias("first")).select("first.*")
    return reduce(DataFrame.unionByName, [first, weak])
