"""Detection by many rules at once: one automaton names the rules that a text can match at all.

Each rule is told by literals of which any match must hold one: its texts, or what its regular expression
can't do without. The automaton of all of them passes over an event's texts once, however many rules there
are, and gives the few that are worth trying. Those are evaluated as data: a rule is a row, joined to the
events that name it, so that the plan doesn't grow with the rules either. Rules that no literal tells
(say ``.*`` or the comparison of two fields) are compiled as before, in :func:`rules.detect`.

The findings are those of :func:`rules.detect`. Literals are ASCII, in lower case, and texts are folded at
least as far as any operator ignores case, so the automaton may name a rule in vain but never misses one.
"""

from __future__ import annotations

import re._constants as kinds  # the parse tree of the standard library's own parser
import re._parser as parser
from collections.abc import Iterable, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tracemill.functions import text as T
from tracemill.sources.events import COLUMNS

from . import rules
from .rules import Rule

#: Characters that ignoring case takes for an ASCII letter, besides what lower case does.
_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})
_GAP = "\0"


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _longest_plain(text: str) -> str:
    """The longest stretch of ASCII in a literal."""
    return max("".join(c if c.isascii() and c != _GAP else "\n\n" for c in text.lower()).split("\n\n"), key=len)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """Of two sets of which a match holds one each, that with the longer least literal."""
    if a is None or b is None:
        return a or b
    worth = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=worth)


def _needed(tree) -> set[str] | None:
    """Literals of which each match of a parsed pattern holds one, None where there are none."""
    best, run = None, ""
    for kind, value in [*tree, (None, None)]:
        if kind is kinds.LITERAL and 0 < value < 128:
            run += chr(value).lower()
            continue
        best, run = _better(best, {run} if run else None), ""
        inner = None
        if kind is kinds.SUBPATTERN:
            inner = None if value[1] & ~parser.SRE_FLAG_IGNORECASE or value[2] else _needed(value[3])
        elif kind is kinds.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            inner = set().union(*each) if all(each) else None
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        elif kind is kinds.ATOMIC_GROUP:
            inner = _needed(value)
        best = _better(best, inner)
    return best


def literals(rule: Rule) -> set[str] | None:
    """Literals of which any text that the rule matches holds one; None if nothing is known of it."""
    if rule.operator == "regex":
        tree = parser.parse(rule.pattern, parser.SRE_FLAG_IGNORECASE)
        found = None if tree.state.flags & parser.SRE_FLAG_VERBOSE else _needed(tree)
    elif rule.operator.endswith("_field"):
        found = None
    else:
        parts = [p for p in rule.pattern.split("|") if p] if rule.operator == "contains" else [rule.pattern]
        found = {_longest_plain(p) for p in parts}
    return found if found and all(found) else None


def automaton(wanted: Sequence[set[str]]) -> ahocorasick.Automaton:
    """Finds every literal; its value are the places of the rules that name it."""
    places: dict[str, list[int]] = {}
    for k, literals_of in enumerate(wanted):
        for literal in literals_of:
            places.setdefault(literal, []).append(k)
    built = ahocorasick.Automaton()
    for literal, held in places.items():
        built.add_word(literal, tuple(held))
    built.make_automaton()
    return built


def candidates(text: Column, wanted: Sequence[set[str]]) -> Column:
    """The places of the rules that a text may match, ascending."""

    @F.pandas_udf("array<int>")
    def named(texts: pd.Series) -> pd.Series:
        built = automaton(wanted)
        return texts.map(lambda t: sorted({k for _, held in built.iter(fold(t)) for k in held}))

    return named.asNondeterministic()(text)  # it isn't; but so it is worked out once, and not again in each filter


def _matched(of: Column, text: Column, other: Column) -> Column:
    """:func:`rules.matched` with operator, pattern and the rest from a row."""
    low = F.lower(text)
    alternatives = F.transform(of["parts"], lambda p: F.when(F.position(p, low) > 0, F.substring(text, F.position(p, low), F.char_length(p))))
    same = (F.lower(F.trim(text)) == F.lower(F.trim(other))) | (of["hosts"] & (T.short_host(text) == T.short_host(other)))
    operator, pattern = of["operator"], of["pattern"]
    return (
        F.when(operator == "contains", F.get(F.filter(alternatives, lambda a: a.isNotNull()), F.lit(0)))
        .when(operator == "startswith", F.when(F.startswith(low, pattern), F.substring(text, F.lit(1), F.char_length(pattern))))
        .when(operator == "endswith", F.when(F.endswith(low, pattern), F.right(text, F.char_length(pattern))))
        .when(operator == "equals", F.when(low == pattern, text))
        .when(operator == "regex", F.regexp_substr(text, pattern))
        .when(operator == "equals_field", F.when(same & (F.trim(text) != ""), text))
        .otherwise(F.when((T.base_name(text) != T.base_name(other)) & (T.base_name(text) != "") & (T.base_name(other) != ""), text))
    )


_OF = "struct<operator:string,pattern:string,parts:array<string>,hosts:boolean,other:int>"
_RULE = f"k int, rule_id string, rule_name string, severity string, technique string, of {_OF}, places array<int>, conditions array<struct<place:int,of:{_OF}>>"


def _of(operator: str, pattern: str, name: str, place: dict[str, int]) -> Row:
    """An operator with its pattern, as a row; ``other`` is the place of the field that the pattern names."""
    compares = operator.endswith("_field")
    text = "(?imdU)" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z") if operator == "regex" else pattern if compares else pattern.lower()
    parts = [p.lower() for p in pattern.split("|") if p] if operator == "contains" else []
    return Row(operator=operator, pattern=text, parts=parts, hosts="host" in (pattern, name), other=place[pattern] if compares else 0)


def detect(events: DataFrame, detection: Iterable[Rule], distinct: bool = True) -> DataFrame:
    """The findings of all rules in all events, as :func:`rules.detect` gives them; time and plan hardly grow with the rules.

    The rules are metadata of the program: they are sent to every task, as automaton and as broadcast rows.
    """
    detection = list(detection)
    told = [(r, found) for r in detection if (found := literals(r))]
    plain = [r for r in detection if not literals(r)]
    if not told:
        return rules.detect(events, plain, distinct)
    ready = rules.Prepared(events, [r for r, _ in told])
    rows = []
    for k, (r, _) in enumerate(told):
        own = list(dict.fromkeys([r.field, *r.fields, "command_line"]))
        conditions = [Row(place=ready.place[c.field], of=_of(c.operator, c.pattern, c.field, ready.place)) for c in r.all_of]
        rows.append(Row(k=k, rule_id=r.id, rule_name=r.name, severity=r.severity, technique=r.technique, of=_of(r.operator, r.pattern, r.field, ready.place), places=[ready.place[n] for n in own], conditions=conditions))
    table = events.sparkSession.createDataFrame(rows, _RULE)
    looked_at = dict.fromkeys(n for r, _ in told for n in (r.field, *r.fields, "command_line"))
    whole = F.concat_ws(_GAP, *[ready.text(n) for n in looked_at], F.array_join("_decoded", _GAP))
    texts = F.array(*[F.col(f"_f{k}") for k in ready.place.values()])
    named = ready.events.select(*COLUMNS, texts.alias("_texts"), "_decoded", whole.alias("_whole")).withColumn("_named", candidates(F.col("_whole"), [w for _, w in told]))
    pairs = named.where(F.size("_named") > 0).select(*COLUMNS, "_texts", "_decoded", F.explode("_named").alias("k")).join(F.broadcast(table), "k")

    text_at = lambda place: F.get(F.col("_texts"), place)
    hit = lambda of, text: F.struct(_matched(of, text, text_at(of["other"])).alias("value"), text.alias("text"))
    hits = F.concat(F.transform("places", lambda p: hit(F.col("of"), text_at(p))), F.transform("_decoded", lambda t: hit(F.col("of"), t)))
    holds = F.forall("conditions", lambda c: _matched(c["of"], text_at(c["place"]), text_at(c["of"]["other"])).isNotNull() & (text_at(c["place"]) != ""))
    first = F.get(F.filter(hits, lambda h: h["value"].isNotNull()), F.lit(0))
    found = pairs.where(holds).withColumn("hit", first).where("hit IS NOT NULL")
    value, text = F.col("hit.value"), F.col("hit.text")
    found = found.select(*COLUMNS, "rule_id", "rule_name", "severity", "technique", value.alias("matched_value"), T.context(text, value).alias("matched_context"))
    if plain:
        found = found.unionByName(rules.detect(events, plain, False))
    return rules.folded(found) if distinct else found
