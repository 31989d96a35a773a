"""Windows events as XML: exported text is cut into records, each read to the columns of an event and a structured record.

Binary logs are read after an export to XML; no reader of theirs is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as T

from .events import COMMAND_NAMES, DATA_USER_NAMES, instant, lookup

MAX_RECORD = 16 * 1024 * 1024
DEFAULT_SOURCE = "WindowsEventLog"
_SYSTEM = (
    "Provider struct<_Name:string,_Guid:string>, EventID struct<_VALUE:string,_Qualifiers:string>, Version string, Level string, Task string, Opcode string, Keywords string, TimeCreated struct<_SystemTime:string>,"
    " EventRecordID string, Execution struct<_ProcessID:string,_ThreadID:string>, Channel string, Computer string, Security struct<_UserID:string>"
)
SCHEMA = f"System struct<{_SYSTEM.replace(' struct', ':struct').replace(' string', ':string').replace(', ', ',')}>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, xml) of every ``<Event ...> ... </Event>`` under a path, over any line ends; one of more than 16 Mi characters, or without an end, fails the job."""
    parts = spark.read.option("recursiveFileLookup", "true").option("lineSep", "</Event>").text(path)
    body = F.regexp_extract("value", r"(?s)(<(?:\w+:)?Event[\s>].*)$", 1)
    cut = parts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), body.alias("body")).where("body <> ''")
    fits = F.char_length("body") <= MAX_RECORD
    xml = F.when(fits, F.concat("body", F.lit("</Event>"))).otherwise(F.raise_error(F.lit("an event is too long")).cast("string"))
    return cut.select("path", "ord", xml.alias("xml"))


def grouped(data: Column) -> Column:
    """Named values of event data, the values of a repeated name as a list, in order."""
    named = F.filter(F.coalesce(data, F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda d: d["_Name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(F.filter(named, lambda d: d["_Name"] == n), lambda d: F.coalesce(d["_VALUE"], F.lit(""))))))


def _xpath(path: str) -> Column:
    return F.nullif(F.xpath_string("bare", F.lit(path)), F.lit(""))


def events(frames: DataFrame) -> DataFrame:
    """Events of records (ord, xml), in the columns of :mod:`events`; records that can't be read are left out.

    ``raw`` holds System, event_data (lists where a name repeats), unnamed data and the tree of UserData as
    text. The first command line and the first user of the data win; the source is the provider.
    """
    # Namespaces only make names longer: they are dropped before reading.
    bare = F.regexp_replace(F.regexp_replace("xml", r"\sxmlns(?::\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"(</?)\w++:(\w)", "$1$2")
    # A condition on the record would read it once more before it is read for the columns; as a list of one it is read once.
    record = F.filter(F.array(F.from_xml("bare", SCHEMA, {"rowTag": "Event", "mode": "PERMISSIVE"})), lambda e: e["System"].isNotNull())
    read = frames.select("ord", bare.alias("bare")).select("ord", "bare", F.explode(record).alias("e"))
    data = F.col("e.EventData.Data")
    unnamed = F.transform(F.filter(F.coalesce(data, F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNull()), lambda d: F.coalesce(d["_VALUE"], F.lit("")))
    user_data = F.nullif(F.regexp_extract("bare", r"(?s)<UserData[^>]*>(.*)</UserData>", 1), F.lit(""))
    listed = read.select("ord", "bare", "e", grouped(data).alias("several"))
    single = F.transform_values("several", lambda _, v: v[0])
    parsed = listed.select("ord", "e", "several", single.alias("d"), unnamed.alias("unnamed"), user_data.alias("user_data"), F.coalesce(F.col("e.System.EventID._VALUE"), _xpath("Event/System/EventID")).alias("id"))
    s = F.col("e.System")
    system = F.struct(
        s["Provider"]["_Name"].alias("ProviderName"), s["Provider"]["_Guid"].alias("ProviderGuid"), F.col("id").alias("EventID"), *[s[c].alias(c) for c in ("Version", "Level", "Task", "Opcode", "Keywords", "EventRecordID", "Channel", "Computer")],
        s["TimeCreated"]["_SystemTime"].alias("SystemTime"), s["Execution"]["_ProcessID"].alias("ProcessID"), s["Execution"]["_ThreadID"].alias("ThreadID"), s["Security"]["_UserID"].alias("UserID"),
    )
    time = F.coalesce(s["TimeCreated"]["_SystemTime"], F.lit(""))
    raw = F.to_json(F.struct(system.alias("system"), F.col("d").alias("event_data"), F.map_filter("several", lambda _, v: F.size(v) > 1).alias("event_data_lists"), "unnamed", "user_data"))
    return parsed.select(
        "ord", instant(F.regexp_replace(time, r"(\.\d{6})\d+", "$1")).alias("ts_us"), time.alias("timestamp"), F.coalesce(T.filled(s["Computer"]), F.lit("unknown")).alias("host"),
        F.coalesce(T.filled(s["Provider"]["_Name"]), F.lit(DEFAULT_SOURCE)).alias("source"), F.coalesce("id", F.lit("")).alias("event_id"), F.coalesce(s["Level"], F.lit("")).alias("level"),
        F.coalesce(lookup(F.col("d"), *DATA_USER_NAMES), s["Security"]["_UserID"], F.lit("")).alias("user"), lookup(F.col("d"), *COMMAND_NAMES).alias("command_line"), raw.alias("raw"),
    )
