"""Detection rules: declared as data, compiled to columns, applied to all events in one scan."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import decode
from tracemill.functions import text as T
from tracemill.sources.events import COLUMNS

OPERATORS = ("contains", "startswith", "endswith", "equals", "regex", "equals_field", "basename_not_equals_field")
SEVERITIES = ("low", "medium", "high", "critical")
# The rules that stand in where a folder has none, and techniques that a rule shows besides its own.
DEFAULT_RULES = (
    {"id": "R-ENC", "name": "Encoded PowerShell Command", "field": "command_line", "pattern": r"powershell(?:\.exe)?\s+.*-(?:enc|encodedcommand)\s+([A-Za-z0-9+/=]{16,})", "mitre_technique": "T1059.001", "severity": "medium", "operator": "regex"},
    {"id": "R-DL", "name": "Suspicious Web Download", "field": "command_line", "pattern": r"(webrequest|wget|curl|net\.webclient)", "mitre_technique": "T1105", "severity": "medium", "operator": "regex"},
)
FURTHER_TECHNIQUES = {"R-ENC": ("T1027.010",)}
LONGEST_PATTERN, LONGEST_ID = 8000, 120
# Severities of Sigma levels; others are medium.
SIGMA_SEVERITIES = {"informational": "low", "info": "low", "low": "low", "high": "high", "critical": "critical", "fatal": "critical"}


@dataclass(frozen=True)
class Condition:
    field: str
    pattern: str
    operator: str = "equals"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    field: str
    pattern: str
    operator: str = ""
    severity: str = "medium"
    technique: str | None = None
    fields: tuple[str, ...] = ()
    all_of: tuple[Condition, ...] = ()

    def __post_init__(self):
        if not self.operator:  # "contains:text" names the operator in the pattern; else it is a regular expression
            prefix, sign, rest = self.pattern.partition(":")
            named = sign and prefix in OPERATORS[:4]
            object.__setattr__(self, "operator", prefix if named else "regex")
            object.__setattr__(self, "pattern", rest if named else self.pattern)
        object.__setattr__(self, "severity", self.severity.lower())
        if not (self.id and self.field and self.pattern):
            raise ValueError(f"rule {self.id!r} lacks an id, a field or a pattern")
        for held in (self, *self.all_of):
            if held.operator not in OPERATORS:
                raise ValueError(f"rule {self.id!r}: unknown operator {held.operator!r}")
            if held.operator == "regex":
                re.compile(held.pattern)


def rule_of(mapping: dict) -> Rule:
    """A rule of its mapping in a rule file."""
    fields = mapping.get("fields") or ()
    fields = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else fields
    known = {k: mapping[k] for k in ("id", "name", "field", "pattern", "operator", "severity") if mapping.get(k)}
    conditions = tuple(Condition(c["field"], str(c["pattern"]), c.get("operator") or "equals") for c in mapping.get("all_of") or ())
    return Rule(**known | {"pattern": str(known["pattern"])}, technique=mapping.get("mitre_technique"), fields=tuple(fields), all_of=conditions)


def sigma_rule(document: dict) -> Rule:
    """A Sigma rule whose only selection is ``CommandLine|contains``; others are refused, as a part of them would mean something else."""
    title = str(document.get("title") or "Sigma rule")
    detection = document.get("detection")
    chosen = detection.get("condition") if isinstance(detection, dict) else None
    name = chosen.strip() if isinstance(chosen, str) else ""
    selection = detection.get(name) if name else None
    if not isinstance(selection, dict) or len(selection) != 1 or set(detection) - {"condition", "timeframe", name}:
        raise ValueError(f"Sigma rule {title!r}: the condition must name the only selection, of one field")
    ((asked, values),) = selection.items()
    values = [values] if isinstance(values, str) else values
    if [p.strip().casefold() for p in str(asked).split("|")] != ["commandline", "contains"]:
        raise ValueError(f"Sigma rule {title!r}: {asked!r} isn't supported")
    if not isinstance(values, list) or not all(isinstance(v, str) and "|" not in v for v in values) or not any(values):
        raise ValueError(f"Sigma rule {title!r}: values must be texts without bars")
    severity = SIGMA_SEVERITIES.get(str(document.get("level") or "").strip().casefold(), "medium")
    tags = [t for t in document.get("tags") or () if isinstance(t, str) and t.casefold().startswith("attack.t")]
    technique = tags[0][len("attack.") :].upper() if tags else None
    return Rule(str(document.get("id") or title), title, "command_line", "|".join(v for v in values if v), "contains", severity, technique)


def load_rules(folder: str) -> list[Rule]:
    """Rules of all JSON and YAML files under a folder, by path. Rule files are metadata: they are read on the driver."""
    found = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".json", ".yml", ".yaml")):
        if path.suffix == ".json":
            content = json.loads(path.read_text())
        else:
            import yaml

            content = [m for document in yaml.safe_load_all(path.read_text()) if document for m in (document if isinstance(document, list) else [document])]
        found += [sigma_rule(m) if "detection" in m else rule_of(m) for m in (content if isinstance(content, list) else [content])]
    return found or [rule_of(m) for m in DEFAULT_RULES]


def with_added(rules: Iterable[Rule], added: Iterable[Rule]) -> list[Rule]:
    """Rules and an organisation's own; two of one id, whatever the case, are an error."""
    both = [*rules, *added]
    ids = [r.id.casefold() for r in both]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"rule ids stand twice: {', '.join(repeated)}")
    return both


def authored_rule(mapping: dict) -> Rule:
    """A rule that a person wrote: its id, pattern, severity and operator are held to narrower limits than those of rule files."""
    rule_id, pattern = str(mapping.get("id") or "").strip(), str(mapping.get("pattern") or "")
    severity, operator = str(mapping.get("severity") or "medium").strip().lower(), str(mapping.get("operator") or "regex").strip().lower()
    if len(rule_id) > LONGEST_ID or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:-]*", rule_id):
        raise ValueError(f"rule id {rule_id!r} isn't made of letters, digits and . _ : -")
    if not pattern or len(pattern) > LONGEST_PATTERN or severity not in SEVERITIES or operator not in OPERATORS[:5]:
        raise ValueError(f"rule {rule_id!r}: pattern, severity or operator is outside the limits")
    return rule_of(mapping | {"id": rule_id, "name": mapping.get("name") or rule_id, "field": mapping.get("field") or "command_line", "severity": severity, "operator": operator})


def techniques_of(rule_id: Column, primary: Column) -> Column:
    """A rule's own technique and those that it shows besides, in order, each once."""
    further = F.create_map(*[x for r, codes in FURTHER_TECHNIQUES.items() for x in (F.lit(r), F.array(*map(F.lit, codes)))])
    own = F.filter(F.array(F.upper(F.trim(primary))), lambda t: t.rlike(r"^T\d{4}(\.\d{3})?$"))
    return F.array_distinct(F.concat(own, F.coalesce(further[rule_id], F.array().cast("array<string>"))))


def tree_hash(folder: str) -> str:
    """SHA-256 over the rule files of a folder by path, with line ends as line feeds."""
    whole = hashlib.sha256()
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".json", ".yml", ".yaml")):
        whole.update(path.relative_to(folder).as_posix().encode() + b"\0" + path.read_bytes().replace(b"\r\n", b"\n") + b"\0")
    return whole.hexdigest()


def select_rules(rules: Iterable[Rule], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[Rule]:
    """Rules by id, whatever the case, before any plan is built."""
    wanted, unwanted = {i.casefold() for i in include}, {i.casefold() for i in exclude}
    return [r for r in rules if (not wanted or r.id.casefold() in wanted) and r.id.casefold() not in unwanted]


#: Texts that every rule looks at besides its own fields; the decoded ones follow the command line.
TEXTS = ("command_line", "raw.script", "raw.payload", "raw.message")


def field(name: str) -> Column:
    """An event's column, or else a dotted path in its record; empty where it is missing."""
    path = name.removeprefix("raw.")
    inner = F.get_json_object("raw", f"$.{path}")
    own = F.col(name).cast("string") if name in COLUMNS else F.lit(None)
    return F.coalesce(F.nullif(own, F.lit("")), inner, F.lit(""))


def decoded_texts(command: Column) -> Column:
    """What a command line hides: its encoded arguments, the script behind it, and itself if it is encoded."""
    whole = decode.script(command)["decoded"]
    found = F.concat(decode.encoded_arguments(command), F.array(whole, decode.base64_text(command)))
    # Few command lines hide anything; the others are told by one pattern.
    may_hide = command.rlike(r"(?i)-enc|\$\w+\s*=\s*['\"]|^[A-Za-z0-9+/]{8,}={0,2}$")
    return F.when(may_hide, F.array_distinct(F.filter(found, lambda t: t.isNotNull() & (t != "") & (t != command)))).otherwise(F.array().cast("array<string>"))


def matched(operator: str, text: Column, pattern: str, name: str = "", low: Column | None = None, other: Column | None = None) -> Column:
    """The part of ``text`` that the pattern matches, null if it doesn't. All but patterns ignore case by lower case.

    ``low`` is the text in lower case and ``other`` the field that ``pattern`` names, where they are known already.
    """
    low = F.lower(text) if low is None else low
    if operator == "contains":
        places = [(F.locate(t.lower(), low), len(t)) for t in pattern.split("|") if t]
        return F.coalesce(*[F.when(at > 0, F.substring(text, at, F.lit(n))) for at, n in places])
    if operator == "startswith":
        return F.when(low.startswith(pattern.lower()), F.substring(text, F.lit(1), F.lit(len(pattern))))
    if operator == "endswith":
        return F.when(low.endswith(pattern.lower()), F.right(text, F.lit(len(pattern))))
    if operator == "equals":
        return F.when(low == pattern.lower(), text)
    if operator == "regex":
        java = "(?imdU)" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
        return F.when(text.rlike(java), F.regexp_extract(text, java, 0))
    other = field(pattern) if other is None else other
    if operator == "equals_field":
        same = F.lower(F.trim(text)) == F.lower(F.trim(other))
        if "host" in (pattern, name):  # short and full names of a host are the same
            same = same | (T.short_host(text) == T.short_host(other))
        return F.when(same & (F.trim(text) != ""), text)
    return F.when((T.base_name(text) != T.base_name(other)) & (T.base_name(text) != "") & (T.base_name(other) != ""), text)


class Prepared:
    """Events with every field that rules look at as one column, in lower case as well, so that no rule parses the record again."""

    def __init__(self, events: DataFrame, rules: list[Rule]):
        names = dict.fromkeys([*TEXTS, *(n for r in rules for n in (r.field, *r.fields))])
        for condition in (c for r in rules for c in (r, *r.all_of)):
            names.setdefault(condition.field)
            if condition.operator.endswith("_field"):
                names.setdefault(condition.pattern)
        self.place = {n: k for k, n in enumerate(names)}
        shown = [field(n).alias(f"_f{k}") for n, k in self.place.items()]
        self.events = events.select(*COLUMNS, *shown).select("*", *[F.lower(f"_f{k}").alias(f"_l{k}") for k in self.place.values()], self._others().alias("_decoded"))

    def _others(self) -> Column:
        """Texts besides the command line that every rule looks at: decoded ones, then those of the record; most events have none."""
        return F.concat(decoded_texts(self.text("command_line")), F.filter(F.array(*[self.text(n) for n in TEXTS[1:]]), lambda t: t != ""))

    def text(self, name: str) -> Column:
        return F.col(f"_f{self.place[name]}")

    def matched(self, operator: str, name: str, pattern: str) -> Column:
        other = self.text(pattern) if operator.endswith("_field") else None
        return matched(operator, self.text(name), pattern, name, F.col(f"_l{self.place[name]}"), other)

    def finding(self, rule: Rule) -> Column:
        """A rule's finding in an event, null without one: the first candidate text that matches gives the value."""
        own = list(dict.fromkeys([rule.field, *rule.fields]))
        compares = rule.operator.endswith("_field")
        struct = lambda value, text: F.struct(value.alias("value"), text.alias("text"))
        one = lambda n: F.when(self.matched(rule.operator, n, rule.pattern).isNotNull(), struct(self.matched(rule.operator, n, rule.pattern), self.text(n)))
        hits = [one(n) for n in own]
        if not compares:
            if "command_line" not in own:
                hits.append(one("command_line"))
            hidden = F.filter(F.transform("_decoded", lambda t: struct(matched(rule.operator, t, rule.pattern), t)), lambda h: h["value"].isNotNull())
            hits.append(F.when(F.size("_decoded") > 0, F.get(hidden, F.lit(0))))
        hit = F.coalesce(*hits)
        holds = [self.matched(c.operator, c.field, c.pattern).isNotNull() & (self.text(c.field) != "") for c in rule.all_of]
        about = [F.lit(v).cast("string").alias(n) for n, v in (("rule_id", rule.id), ("rule_name", rule.name), ("severity", rule.severity), ("technique", rule.technique))]
        found = F.when(hit.isNotNull(), F.struct(*about, hit.alias("hit")))
        return F.when(reduce(lambda a, b: a & b, holds), found) if holds else found


def detect(events: DataFrame, rules: Iterable[Rule], distinct: bool = True) -> DataFrame:
    """Findings of all rules in all events: one scan, no shuffle; then the first of each (rule, event, value).

    The deduplication keeps the least ``ord`` by a partial aggregation, so a group of repeats of any size is
    folded where it lies before it is shuffled.
    """
    rules = list(rules)
    ready = Prepared(events, rules)
    found = ready.events.select(*COLUMNS, F.explode(F.array_compact(F.array(*map(ready.finding, rules)))).alias("f"))
    # The context is cut from rows that match only, after the explosion.
    value, text = F.col("f.hit.value"), F.col("f.hit.text")
    found = found.select(*COLUMNS, *[f"f.{c}" for c in ("rule_id", "rule_name", "severity", "technique")], value.alias("matched_value"), T.context(text, value).alias("matched_context"))
    return folded(found) if distinct else found


def folded(found: DataFrame) -> DataFrame:
    """The first finding of each (rule, event, value)."""
    key = ("rule_id", "timestamp", "host", "source", "event_id", "matched_value")
    return found.groupBy(*key).agg(F.min(F.struct("ord", *[c for c in found.columns if c not in (*key, "ord")])).alias("first")).select(*key, "first.*")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity))


def filter_findings(findings: DataFrame, least: str = "low", techniques: Iterable[str] = (), without: Iterable[str] = (), hosts: Iterable[str] = ()) -> DataFrame:
    """Findings from a severity on, by technique and host."""
    kept = findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least) + 1)
    code = F.upper(F.coalesce("technique", F.lit("")))
    if techniques := [t.upper() for t in techniques]:
        kept = kept.where(code.isin(techniques))
    if without := [t.upper() for t in without]:
        kept = kept.where(~code.isin(without))
    if hosts := [h.lower() for h in hosts]:
        kept = kept.where(F.lower("host").isin(hosts))
    return kept

