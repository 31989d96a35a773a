"""One view of events of any provider: taxonomy, entities and blocks by category, without touching the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.sources.events import lookup

# Providers by a part of their name, the taxonomy, and its other names in correlation patterns.
PROVIDERS = (("security-auditing", "windows.security"), ("sysmon", "windows.sysmon"), ("powershell", "windows.powershell"), ("service control manager", "windows.service_control_manager"))
TAXONOMY = {
    ("windows.security", "4688"): ("process", "process_start"), ("windows.sysmon", "1"): ("process", "process_start"), ("windows.sysmon", "3"): ("network", "connection"),
    ("windows.security", "4624"): ("authentication", "logon_success"), ("windows.security", "4625"): ("authentication", "logon_failure"), ("windows.security", "4698"): ("task", "task_create"),
    ("windows.security", "1102"): ("log", "log_clear"), ("windows.powershell", "4104"): ("script", "script_block"), ("windows.service_control_manager", "7045"): ("service", "service_install"),
}
OTHER_NAMES = {
    "process_start": ("processcreate", "processstart"), "connection": ("networkconnection",), "logon_success": ("logonsuccess", "authenticationsuccess"), "logon_failure": ("logonfailure", "authenticationfailure"),
    "task_create": ("taskcreate", "scheduledtaskcreate"), "log_clear": ("logclear", "eventlogclear"), "script_block": ("scriptblock", "powershellscriptblock"), "service_install": ("serviceinstall", "servicecreate"),
}
#: Fields by block: (name, names in the record). Ports and ids of processes are whole numbers where they can be.
NETWORK = (
    ("source_ip", ("SourceIp", "SourceAddress", "IpAddress")), ("source_port", ("SourcePort", "IpPort")), ("destination_ip", ("DestinationIp", "DestinationAddress", "DestAddress")),
    ("destination_port", ("DestinationPort", "DestPort")), ("destination_host", ("DestinationHostname",)), ("protocol", ("Protocol",)),
)
LOGON = (("logon_type", ("LogonType",)), ("package", ("AuthenticationPackageName",)), ("source_ip", ("IpAddress", "SourceNetworkAddress")), ("source_port", ("IpPort",)))
SERVICE = (("name", ("ServiceName",)), ("image_path", ("ImagePath", "ServiceFileName")), ("start_type", ("StartType", "ServiceStartType")), ("account", ("AccountName", "ServiceAccount")))
TASK = (("name", ("TaskName",)), ("content", ("TaskContent", "TaskContentNew")))
SCRIPT = (("text", ("ScriptBlockText", "Payload", "Message")), ("path", ("Path", "ScriptName")))

_MAP = "map<string,string>"


def provider(source: Column) -> Column:
    low = F.lower(F.trim(source))
    named = F.when(low.isin("security", "windows security"), "windows.security")
    for part, name in PROVIDERS:
        named = F.coalesce(named, F.when(low.contains(part), F.lit(name)))
    return F.coalesce(named, F.trim(source), F.lit(""))


def taxonomy(provider: Column, event_id: Column) -> Column:
    """(category, action), unknown and observed for what isn't in the table."""
    table = F.create_map(*[x for (p, e), (c, a) in TAXONOMY.items() for x in (F.lit(f"{p}|{e}"), F.struct(F.lit(c).alias("category"), F.lit(a).alias("action")))])
    return F.coalesce(table[F.concat_ws("|", provider, event_id)], F.struct(F.lit("unknown").alias("category"), F.lit("observed").alias("action")))


def number_or_text(value: Column) -> Column:
    """A whole number written plainly, other texts as they are."""
    return F.coalesce(T.whole_number(value).cast("string"), T.filled(value))


def _block(fields: Column, names) -> Column:
    return F.struct(*[T.filled(lookup(fields, *of)).alias(name) for name, of in names])


def enrich(events: DataFrame) -> DataFrame:
    """Events with ``canonical``: category, action, code, provider, host, user, session and the blocks of the category; nulls where there is nothing.

    The record's own keys go before those of its ``event_data``; fields of the event fill what neither has.
    """
    raw = F.from_json("raw", _MAP)
    data, system = F.from_json(lookup(raw, "event_data"), _MAP), F.from_json(lookup(raw, "system"), _MAP)
    inner = F.map_filter(raw, lambda k, _: ~F.lower(k).isin("event_data", "event_data_records", "system", "user_data", "canonical"))
    none = F.create_map().cast(_MAP)
    merged = F.map_from_entries(F.concat(F.map_entries(F.coalesce(inner, none)), F.map_entries(F.map_filter(F.coalesce(data, none), lambda k, _: ~F.map_contains_key(F.coalesce(inner, none), k)))))
    read = events.select(*events.columns, merged.alias("_f"), system.alias("_s"))
    f, s = F.col("_f"), F.col("_s")
    shown = provider(F.coalesce(T.filled(F.col("source")), lookup(s, "ProviderName", "Provider")))
    code = F.coalesce(T.filled(F.col("event_id")), lookup(s, "EventID"))
    kind = read.select(*events.columns, "_f", "_s", shown.alias("_p"), code.alias("_c"), taxonomy(shown, code).alias("_t"))
    category, security = F.col("_t.category"), (F.col("_p") == "windows.security") & (F.col("_c") == "4688")
    process = F.struct(
        number_or_text(F.when(security, lookup(f, "NewProcessId")).otherwise(lookup(f, "ProcessId", "NewProcessId"))).alias("pid"),
        number_or_text(F.when(security, lookup(f, "ProcessId", "CreatorProcessId")).otherwise(lookup(f, "ParentProcessId", "CreatorProcessId"))).alias("parent_pid"),
        F.when(security, lookup(f, "NewProcessName")).otherwise(lookup(f, "Image", "NewProcessName", "ProcessName")).alias("executable"),
        lookup(f, "ParentImage", "ParentProcessName").alias("parent_executable"),
        T.filled(F.coalesce("command_line", lookup(f, "CommandLine", "ProcessCommandLine"))).alias("command_line"),
    )
    when = lambda name, block: F.when(category == name, block).alias(name)
    user = F.struct(F.coalesce(T.filled(lookup(f, "TargetUserName", "SubjectUserName", "User", "UserName", "AccountName")), T.filled(F.col("user"))).alias("name"), T.filled(lookup(f, "TargetUserSid", "SubjectUserSid", "UserSid", "UserID")).alias("id"))
    canonical = F.struct(
        "_t.category", "_t.action", number_or_text(F.col("_c")).alias("code"), F.nullif("_p", F.lit("")).alias("provider"),
        F.coalesce(T.filled(F.col("host")), T.filled(lookup(f, "Computer", "Hostname", "computer_name", "Host")), T.filled(lookup(s, "Computer"))).alias("host"), user.alias("user"),
        T.filled(lookup(f, "TargetLogonId", "SubjectLogonId", "LogonId", "SessionId")).alias("session"), process.alias("process"), _block(f, NETWORK).alias("network"),
        when("authentication", _block(f, LOGON)), F.when(category != "script", T.filled(lookup(f, "TargetFilename", "FileName", "Path"))).alias("file"),
        T.filled(lookup(f, "TargetObject", "ObjectName", "RegistryPath")).alias("registry"), when("script", _block(f, SCRIPT)), when("service", _block(f, SERVICE)), when("task", _block(f, TASK)),
    )
    return kind.select(*events.columns, canonical.alias("canonical"))


def tokens(canonical: Column) -> Column:
    """What a correlation pattern may call an event: its category, action and provider, and the action's other names."""
    others = F.create_map(*[x for a, names in OTHER_NAMES.items() for x in (F.lit(a), F.array(*map(F.lit, names)))])
    own = F.transform(F.array(canonical["category"], canonical["action"], canonical["provider"]), lambda v: T.letters(v))
    return F.array_distinct(F.concat(F.filter(own, lambda t: t != ""), F.coalesce(others[canonical["action"]], F.array().cast("array<string>"))))


def called(canonical: Column, patterns) -> Column:
    """Whether one of the source patterns names the event in the canonical vocabulary."""
    asked = [p.removeprefix("source:") for p in patterns if not p.startswith(("event_id:", "cmd:"))]
    return F.arrays_overlap(tokens(canonical), F.array(*[T.letters(F.lit(p)) for p in asked])) if asked else F.lit(False)


# Artifact categories by what an event is called, and by words of its command line.
ARTIFACTS = {
    "EvidenceOfExecution": "prefetch_execution program_execution process_creation", "BrowserHistory": "browser_visit web_activity chrome edge firefox",
    "AccountUsage": "logon logoff account_creation account_modification", "NetworkActivity": "network_connection dns_query firewall_event",
    "FileOperations": "file_creation file_modification file_deletion file_access", "RegistryArtifacts": "usb_registry_device_observed autorun_entry registry_modification registry",
    "SystemConfiguration": "system_configuration service_installation scheduled_task", "UserActivity": "user_activity usb_device usb", "MalwareIndicators": "suspicious_command encoded_command powershell_obfuscation",
}
COMMAND_WORDS = (("EvidenceOfExecution", ("powershell", "cmd.exe", "wscript")), ("BrowserHistory", ("http://", "https://", "www.")))


def artifact_category(event_id: Column, event_type: Column, source: Column, command: Column) -> Column:
    """By event id, type, source, and last by the command line; Other else."""
    table = F.create_map(*[F.lit(x) for c, names in ARTIFACTS.items() for n in names.split() for x in (n, c)])
    by_name = [table[F.lower(F.coalesce(c, F.lit("")))] for c in (event_id, event_type, source)]
    low = F.lower(F.coalesce(command, F.lit("")))
    by_word = [F.when(F.greatest(*[low.contains(w) for w in words]), F.lit(c)) for c, words in COMMAND_WORDS]
    return F.coalesce(*by_name, *by_word, F.lit("Other"))
