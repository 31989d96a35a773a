"""Detection by the automaton against detection by compiled rules, and what the automaton asks of patterns."""

import base64
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.operators import automaton, rules
from tracemill.operators.rules import Condition, Rule
from tracemill.sources import events as sources


def rule(pattern, operator="regex", **more):
    return Rule(f"{operator} {pattern}", "n", more.pop("field", "command_line"), pattern, operator, **more)


@pytest.mark.parametrize(
    "pattern, needed",
    [
        ("abc", {"abc"}), ("ab?cde", {"cde"}), ("(?:foo|barbar)x", {"foo", "barbar"}), ("(foo|b*)", None), (r"\w+", None), ("x{2,}yz", {"yz"}), ("(long literal)+", {"long literal"}), ("a[bc]d", {"a"}),
        ("(?=ahead)b", {"b"}), ("(?!not)cd", {"cd"}), ("(?-i:ABC)d", {"d"}), ("Größe", {"gr"}), (r"^\s*evil\.exe$", {"evil.exe"}), ("(?x) a b", None), ("a|", None), ("(?P<n>tool)(?P=n)", {"tool"}),
    ],
)
def test_literals_of_patterns(pattern, needed):
    assert automaton.literals(rule(pattern)) == needed


def test_literals_of_other_operators():
    assert automaton.literals(rule("One|two three", "contains")) == {"one", "two three"}
    assert automaton.literals(rule("C:/Tmp", "startswith")) == {"c:/tmp"}
    assert automaton.literals(rule("é", "contains")) is None and automaton.literals(rule("host", "equals_field")) is None
    assert automaton.literals(rule("naïve way", "equals")) == {"ve way"}


_ATOMS = st.sampled_from(["ab", "b", "c", ".", r"\w", "[ab]", "(?:ab|c)", "(?:a|)", "(?:bc)+", "c?", "K", "s"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_ATOMS, min_size=1, max_size=5).map("".join), st.text(alphabet="abcKsſ\u212a\u0130 ", max_size=12))
def test_whatever_matches_holds_a_literal(pattern, text):
    needed = automaton.literals(rule(pattern))
    if needed and re.search(pattern, text, re.I):
        assert any(n in automaton.fold(text) for n in needed)


def records():
    hidden = base64.b64encode("Invoke-Mimikatz tool-9.dll".encode("utf-16-le")).decode()
    texts = ["run tool-3.dll now", "C:/Temp/4/x", "prefix LOADER-8 suffix", f"powershell -enc {hidden}", "dump12 --all", "\\dump17  --ALL", "run3.exe", "x /payload2.ps1", "KELVIN \u212aey", "ordinary", "", "tool-3.dll|loader-3", "ſecret"]
    out = []
    for k, t in enumerate(texts * 3):
        out.append({"timestamp": f"2026-01-01T00:{k:02d}:00Z", "host": f"h{k % 3}.corp.local", "source": "S", "event_id": str(k % 4), "user": "u", "command_line": t, "Image": f"C:\\bin\\tool-{k}.dll", "Original": f"tool-{k % 5}.dll", "script": "loader-77 in a script" if k % 7 == 0 else "", "peer": f"H{k % 3}"})
    return out


def many(n):
    kinds = (("contains", "tool-{0}.dll|loader-{0}"), ("regex", r"\\?dump{0}\s+--all\b"), ("endswith", "/payload{0}.ps1"), ("equals", "run{0}.exe"), ("startswith", "c:/temp/{0}/"))
    found = [rule(kinds[k % 5][1].format(k), kinds[k % 5][0], severity="high", technique="T1059", all_of=(Condition("event_id", "1"),) if k % 3 == 0 else ()) for k in range(n)]
    found += [rule("key", "contains"), rule("Secret"), rule(".+ary$"), rule("peer", "equals_field", field="host"), rule("raw.Original", "basename_not_equals_field", field="raw.Image")]
    found += [rule("tool-1", "contains", field="raw.Image", fields=("raw.Original",), all_of=(Condition("host", "peer", "equals_field"), Condition("event_id", "[0-2]", "regex"), Condition("raw.Image", "raw.Original", "basename_not_equals_field")))]
    return found


@pytest.mark.parametrize("n", [70, 300])
def test_same_findings_as_compiled_rules(spark, n):
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records())], "ord long, value string")
    events = sources.from_json_lines(lines)
    wanted = many(n)
    few = [r for r in wanted if any(k in r.pattern for k in ("3", "4", "8", "9", "12", "17", "2", "77", "1")) or not r.pattern[-1:].isdigit()][:60] + wanted[-6:]
    asked = list({r.id: r for r in (wanted if n < 100 else few)}.values())
    by_plan = sorted(map(str, rules.detect(events, asked).select(*sorted(rules.detect(events, asked[:1]).columns)).collect()))
    found = automaton.detect(events, wanted)
    ids = {r.id for r in asked}
    by_automaton = sorted(str(r) for r in found.select(*sorted(found.columns)).collect() if r.rule_id in ids)
    assert by_automaton == by_plan and len(by_plan) > 60


def test_no_rules_told_by_literals_and_no_events(spark):
    events = sources.synthetic(spark, 20)
    assert automaton.detect(events, [rule(r"\d{2}$")]).count() == rules.detect(events, [rule(r"\d{2}$")]).count() == 11
    assert automaton.detect(events.where("false"), many(10)).count() == 0
