"""Names and tactics of techniques."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tactics in the order of an attack, the techniques of each (parts have the tactic of their whole), and names.
TACTICS = (
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact", "Unmapped",
)
BY_TACTIC = {
    "Execution": "T1059 T1047 T1569",
    "Persistence": "T1547 T1053 T1543",
    "Defense Evasion": "T1218 T1197 T1070 T1140 T1127 T1202 T1562",
    "Credential Access": "T1003 T1555",
    "Discovery": "T1087 T1082 T1016 T1018 T1482 T1135 T1057 T1518",
    "Lateral Movement": "T1021",
    "Collection": "T1560 T1115 T1113",
    "Command and Control": "T1105",
    "Exfiltration": "T1567",
    "Impact": "T1490",
}
NAMES = {
    "T1059": "Command and Scripting Interpreter", "T1059.001": "PowerShell", "T1105": "Ingress Tool Transfer", "T1047": "Windows Management Instrumentation",
    "T1218": "System Binary Proxy Execution", "T1218.002": "Control Panel", "T1218.003": "CMSTP", "T1218.004": "InstallUtil", "T1218.005": "Mshta", "T1218.010": "Regsvr32", "T1218.011": "Rundll32",
    "T1547": "Boot or Logon Autostart Execution", "T1547.001": "Registry Run Keys/Startup Folder", "T1053": "Scheduled Task/Job", "T1053.005": "Scheduled Task", "T1197": "BITS Jobs",
    "T1003": "OS Credential Dumping", "T1003.001": "LSASS Memory", "T1003.002": "Security Account Manager", "T1003.003": "NTDS", "T1070": "Indicator Removal", "T1070.001": "Clear Windows Event Logs",
    "T1490": "Inhibit System Recovery", "T1140": "Deobfuscate/Decode Files or Information", "T1087": "Account Discovery", "T1087.001": "Local Account", "T1087.002": "Domain Account",
    "T1082": "System Information Discovery", "T1016": "System Network Configuration Discovery", "T1127": "Trusted Developer Utilities Proxy Execution", "T1127.001": "MSBuild", "T1202": "Indirect Command Execution",
    "T1543": "Create or Modify System Process", "T1543.003": "Windows Service", "T1569": "System Services", "T1569.002": "Service Execution", "T1021": "Remote Services",
    "T1021.001": "Remote Desktop Protocol", "T1021.002": "SMB/Windows Admin Shares", "T1021.006": "Windows Remote Management", "T1562": "Impair Defenses", "T1562.001": "Disable or Modify Tools",
    "T1562.002": "Disable Windows Event Logging", "T1562.004": "Disable or Modify System Firewall", "T1555": "Credentials from Password Stores", "T1555.003": "Credentials from Web Browsers",
    "T1560": "Archive Collected Data", "T1560.001": "Archive via Utility", "T1567": "Exfiltration Over Web Service", "T1567.002": "Exfiltration to Cloud Storage", "T1018": "Remote System Discovery",
    "T1482": "Domain Trust Discovery", "T1135": "Network Share Discovery", "T1057": "Process Discovery", "T1518": "Software Discovery", "T1518.001": "Security Software Discovery",
    "T1115": "Clipboard Data", "T1113": "Screen Capture",
}
CORE = (
    "T1059.001 T1105 T1047 T1218.005 T1218.010 T1218.011 T1547.001 T1053.005 T1003.001 T1003.002 T1003.003 T1070.001 T1490 T1087.001 T1087.002 T1018 T1135 T1482 T1057 T1518.001"
    " T1562.001 T1562.002 T1562.004 T1021.001 T1021.002 T1021.006 T1543.003 T1569.002 T1560.001 T1567.002 T1115 T1113"
).split()


def whole(code: Column) -> Column:
    return F.substring_index(F.upper(code), ".", 1)


def tactic(code: Column) -> Column:
    """The tactic of a technique or of the whole that it is a part of; Unmapped for others."""
    of = [(F.array_contains(F.array(*map(F.lit, codes.split())), whole(code)), name) for name, codes in BY_TACTIC.items()]
    return reduce(lambda rest, pair: F.when(pair[0], F.lit(pair[1])).otherwise(rest), of, F.lit("Unmapped"))


def name(code: Column) -> Column:
    """A technique's name; of a part with its whole before it, or the whole's alone where the part isn't known."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    own, parent = names[F.upper(code)], names[whole(code)]
    return F.coalesce(F.when(F.upper(code) != whole(code), F.concat_ws(": ", parent, own)), own, parent, F.lit("Unknown"))


def tactic_order(value: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TACTICS)), value), F.lit(0)), F.lit(999))
