"""Sources, rules, text functions, sessions and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import decode
from tracemill.functions import text as T
from tracemill.operators import correlation, rules, scenarios, sessions
from tracemill.operators.rules import Condition, Rule
from tracemill.plans.engine import DEFAULT_LINKS, Link, analyse, correlate
from tracemill.sources import events as sources
from tracemill.streaming import detection

RECORDS = [
    {"@timestamp": "2026-01-01T00:00:00Z", "computer_name": "WS1", "source_name": "Sysmon", "event_id": 1, "user": {"name": "bob", "domain": "LAB"}, "event_data": {"CommandLine": "powershell -enc AAAA"}},
    {"timestamp": "2026-01-01T00:00:30", "host": {"name": "ws1"}, "source": "Security", "event_id": "4688", "account": "LAB\\bob", "command_line": "whoami"},
    {"timestamp": "bad", "event_id": "9"},
]


def lines(spark, records=RECORDS):
    texts = [json.dumps(r) for r in records] + ["", "not json", "{broken"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, value string")


def test_records_become_events(spark):
    found = sources.from_json_lines(lines(spark)).orderBy("ord").collect()
    assert [(r.host, r.source, r.event_id, r.user, r.command_line) for r in found] == [
        ("WS1", "Sysmon", "1", "LAB\\bob", "powershell -enc AAAA"), ("ws1", "Security", "4688", "LAB\\bob", "whoami"), ("unknown", "unknown", "9", "", None)]
    assert [r.ts_us for r in found] == [1767225600000000, 1767225630000000, None]


def test_first_of_repeated_records(spark):
    twin = {"timestamp": "2026-01-01T00:00:00Z", "host": "a", "source": "s", "event_id": "1", "System": {"Channel": "Security", "EventRecordID": "7"}}
    loose = {"timestamp": "2026-01-01T00:00:00Z", "host": "a", "source": "s", "event_id": "1"}
    events = sources.normalise(sources.from_json_lines(lines(spark, [twin, twin, loose, loose])))
    assert sorted(r.ord for r in events.collect()) == [0, 2, 3]


@pytest.mark.parametrize(
    "operator,pattern,text,value",
    [
        ("contains", "zzz|SHELL", "PowerShell", "Shell"), ("contains", "x", "abc", None), ("startswith", "POW", "power", "pow"), ("endswith", "ER", "power", "er"),
        ("equals", "Power", "pOWER", "pOWER"), ("regex", r"^b\w+$", "a\nBoc", "Boc"), ("regex", r"a(?!b)", "ab", None), ("regex", r"(?P<n>x)y", "xy", "xy"),
    ],
)
def test_operators(spark, operator, pattern, text, value):
    assert spark.range(1).select(rules.matched(operator, F.lit(text), pattern)).first()[0] == value


def test_rules_fall_back_to_the_command_line_and_hold_all_conditions(spark):
    events = sources.from_json_lines(lines(spark))
    encoded = Rule("E", "encoded", "event_id", "contains:-enc", severity="HIGH", technique="T1059.001")
    both = Rule("B", "both", "command_line", "powershell", "contains", all_of=(Condition("event_data.CommandLine", "-enc", "contains"), Condition("event_id", "1")))
    none = Rule("N", "none", "command_line", "powershell", "contains", all_of=(Condition("event_id", "2"),))
    found = rules.detect(events, [encoded, both, none]).orderBy("rule_id").collect()
    assert [(r.rule_id, r.severity, r.matched_value, r.ord) for r in found] == [("B", "medium", "powershell", 0), ("E", "high", "-enc", 0)]
    assert found[1].matched_context == "powershell -enc AAAA"


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        Rule("X", "x", "f", "p", "unknown")
    assert Rule("X", "x", "f", "a:b").operator == "regex"
    assert [r.id for r in rules.select_rules([Rule("A", "", "f", "p"), Rule("B", "", "f", "p")], exclude=["a"])] == ["B"]


def test_text_functions(spark):
    cases = [
        (decode.base64_text(F.lit("aGVsbG8gd29ybGQh")), "hello world!"), (decode.base64_text(F.lit("not base64!")), None), (T.account_leaf(F.lit("LAB\\Bob")), "bob"),
        (T.account_leaf(F.lit("bob@lab")), "bob"), (T.host_name(F.lit(" WS1.Lab.. ")), "ws1.lab"), (T.short_host(F.lit("WS1.Lab")), "ws1"), (T.process_id(F.lit("0x1F")), 31),
        (T.process_id(F.lit("0")), None), (T.redact(F.lit("x -enc " + "A" * 30)), "x [REDACTED] [BASE64...REDACTED]"), (T.shorten(F.lit("abcd"), 3), "ab…"),
    ]
    assert list(spark.range(1).select(*[c for c, _ in cases]).first()) == [v for _, v in cases]
    found = spark.range(1).select(T.indicators(F.lit("see http://a.example.com/x, 10.0.0.1 and 999.1.1.1 at C:\\Temp\\x.exe"))).first()[0]
    assert {(r.kind, r.value) for r in found} == {("url", "http://a.example.com/x"), ("ip", "10.0.0.1"), ("domain", "a.example.com"), ("path", "C:\\Temp\\x.exe")}


def timeline(spark, minutes):
    return spark.createDataFrame([(i, m * 60_000_000, "u") for i, m in enumerate(minutes)], "ord long, ts_us long, user string")


def test_three_cuts_differ(spark):
    line = timeline(spark, [0, 20, 40, 60, 200])
    assert [r.session for r in sessions.by_gap(line, "user", 1800).orderBy("ord").collect()] == [1, 1, 1, 1, 2]
    assert [r.anchor_us // 60_000_000 for r in sessions.from_anchor(line, "user", 1800).orderBy("ord").collect()] == [0, 0, 40, 40, 200]
    kept = sessions.by_lifecycle(line, "user", F.col("ord") == 1, F.col("ord") == 3)
    assert [r.ord for r in kept.orderBy("ord").collect()] == [1, 2, 3]


def test_interval_edges(spark):
    line = timeline(spark, [0, 0, 5, 6])
    pairs = correlation.interval_join(line.where("ord = 0"), line, ["user"], 300).select("b_ord").orderBy("b_ord").collect()
    assert [r.b_ord for r in pairs] == [1, 2]


def test_sigma_rules():
    document = {"title": "Download", "level": "fatal", "tags": ["attack.execution", "attack.t1105"], "detection": {"sel": {"CommandLine|contains": ["curl", "wget"]}, "condition": "sel"}}
    rule = rules.sigma_rule(document)
    assert (rule.id, rule.pattern, rule.operator, rule.severity, rule.technique) == ("Download", "curl|wget", "contains", "critical", "T1105")
    for detection in ({"sel": {"Image|contains": "x"}, "condition": "sel"}, {"sel": {"CommandLine|contains": "x"}, "other": {}, "condition": "sel"}, {"sel": {"CommandLine|contains": "a|b"}, "condition": "sel"}, {"condition": "not sel"}):
        with pytest.raises(ValueError):
            rules.sigma_rule({"title": "x", "detection": detection})


def test_scenarios(spark):
    chains = spark.createDataFrame([("a", "download"), ("b", "other"), (None, "download")], "host string, kind string")
    findings = spark.createDataFrame([("a", "t1059.001"), ("a", "T1105"), ("b", "T1105"), (None, "T1105"), ("c", "T1105"), ("b", None)], "host string, technique string")
    templates = [
        scenarios.template_of({"id": "P", "title": "parent", "required_techniques": "T1059", "optional_techniques": ["T1059.001"], "chain_patterns": ["download"]}),
        scenarios.Template("B", "broad", ("T1059",)),  # the part isn't named by the template, so it doesn't count
        scenarios.Template("D", "download", ("T1105",)),
    ]
    found = scenarios.infer(chains, findings, templates, ["host"]).orderBy("host", "template_id").collect()
    assert [(r.host, r.template_id, r.techniques, r.n_chains, r.confidence) for r in found] == [("a", "D", ["T1105"], 1, 0.74), ("a", "P", ["T1059.001"], 1, 0.64), ("b", "D", ["T1105"], 1, 0.74)]
    assert scenarios.infer(chains.limit(0), findings, templates, ["host"]).count() == 0
    with pytest.raises(ValueError):
        scenarios.template_of({"id": "x", "name": "x"})


def test_default_links(spark):
    events = [(0, 0, "Net", "1", "curl http://x", "WS", "u"), (1, 5_000_000, "Security", "4688", None, "ws", "v"), (2, 9_000_000, "ProcessCreate", "9", "", "other", "u")]
    frame = spark.createDataFrame(events, "ord long, ts_us long, source string, event_id string, command_line string, host string, user string")
    none = spark.createDataFrame([], "ord long, severity string")
    assert [(r.kind, r.a_ord, r.n_events) for r in correlate(frame, none, DEFAULT_LINKS).collect()] == [("download_exec", 0, 2)]


def test_chain_confidence(spark):
    value = correlation.chain_confidence(F.lit(2), F.lit(30_000_000), F.lit(0.2), F.lit(1))
    zero = correlation.chain_confidence(F.lit(2), F.lit(0), F.lit(0.2), F.lit(1))
    assert [round(v, 6) for v in spark.range(1).select(value, zero).first()] == [0.72, 0.52]


def test_whole_analysis_on_synthetic_events(spark):
    rule = Rule("E", "encoded", "command_line", "-enc", "contains", "high", "T1059.001")
    results = analyse(sources.synthetic(spark, 5000), [rule], [Link("near", "Sysmon", "Sysmon", 32, ("host", "user"))])
    assert results.findings.count() == 5
    assert results.risk.first().level == "critical"
    assert results.chains.count() == 5000 - 32


def test_analysis_of_a_remote_service(spark, tmp_path):
    def at(second, host, event_id, **more):
        return {"timestamp": f"2026-01-01T00:00:{second:02d}Z", "host": host, "source": "Microsoft-Windows-Security-Auditing", "event_id": event_id, "user": "LAB\\bob"} | more

    records = [
        at(0, "a.lab", "4688", command_line="psexec.exe \\\\b cmd", NewProcessId="0x10", NewProcessName="psexec.exe"),
        at(2, "b.lab", "4624", LogonType="3", TargetUserName="bob", TargetLogonId="0x0A"),
        at(4, "b.lab", "4688", command_line="C:\\Windows\\PSEXESVC.exe", NewProcessId="0x20", NewProcessName="psexesvc.exe"),
        at(6, "b.lab", "4688", command_line="cmd", NewProcessId="0x30", ProcessId="0x20"),
        at(9, "b.lab", "4634", TargetLogonId="0xa"),
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, records)))
    found = analyse(sources.read_json_lines(spark, str(tmp_path)), [Rule("P", "remote tool", "command_line", "psexe", "contains", "high", "T1569.002")])
    kinds = {r.kind: r for r in found.chains.collect()}
    assert set(kinds) == {"session", "remote_execution"} and kinds["session"].chain_id == "session_b.lab_0xa"
    assert [r.ord for r in found.members.where("kind = 'remote_execution'").orderBy("ord").collect()] == [0, 1, 2]
    assert [(r.source_host, r.target_host, r.technique, r.n_chains) for r in found.episodes.collect()] == [("a.lab", "b.lab", "T1569.002", 1)]
    assert found.events.where("ord = 3 AND raw LIKE '%ParentProcessName%psexesvc.exe%'").count() == 1
    assert found.placed.count() == 2 and found.scenarios.count() == 0
    found.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "chains")).count() == 2


def test_store_writes_once(spark, tmp_path):
    from tracemill.operators import store

    events = sources.synthetic(spark, 50)
    for _ in range(2):
        store.store_events(events, str(tmp_path))
        store.store_findings(rules.detect(events, [Rule("E", "e", "command_line", "--job 7", "contains")]), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/events").count() == 50 and spark.read.parquet(f"{tmp_path}/findings").count() == 1
    chains = spark.createDataFrame([("c1", 0.5), ("c2", 0.5)], "chain_id string, confidence double")
    members = spark.createDataFrame([("c1", 1), ("c1", 1)], "chain_id string, ord long")
    store.store_chains(chains, members, str(tmp_path), "g1")
    store.store_chains(chains.where("chain_id = 'c1'").withColumn("confidence", F.lit(0.9)), members, str(tmp_path), "g2")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/chains/g2").select("chain_id", "confidence").collect())) == [("c1", 0.9), ("c2", 0.5)]
    assert spark.read.parquet(f"{tmp_path}/members/g2").count() == 1


def test_browser_history_and_archives(spark, tmp_path):
    import bz2
    import sqlite3
    import zipfile

    from tracemill.sources import artifacts

    (tmp_path / "profile").mkdir()
    base = sqlite3.connect(tmp_path / "profile" / "History")
    base.executescript("CREATE TABLE urls(id, url, title, visit_count, last_visit_time); CREATE TABLE visits(id, url, visit_time); INSERT INTO urls VALUES (1, 'http://x', 'X', 1, 0); INSERT INTO visits VALUES (1, 1, 11644473600000001), (2, 1, 0), (3, 9, 5);")
    base.commit()
    base.close()
    assert [tuple(r)[1:] for r in artifacts.browser_history(spark, str(tmp_path)).collect()] == [(1, "http://x", "X", "1970-01-01T00:00:00.000001+00:00")]
    with zipfile.ZipFile(tmp_path / "logs.zip", "w") as box:
        box.writestr("a.jsonl", '{"a": 1}\n{"a": 2}\n')
        box.writestr("b.jsonl.bz2", bz2.compress(b'{"b": 1}\n'))
    assert [(r.member, r.line) for r in artifacts.archived_lines(spark, str(tmp_path)).orderBy("member", "line").collect()] == [("a.jsonl", 0), ("a.jsonl", 1), ("b.jsonl.bz2", 0)]


def test_decoders(spark):
    row = spark.range(1).select(
        decode.script(F.lit("SUVYKCR4KQ==")).alias("a"), decode.script(F.lit("$v = 'calc'; & $v; IEX ($v)")).alias("b"), decode.macro(F.lit('x = Chr(65) & "b"')).alias("c"),
        decode.plain_cipher(F.lit("uryyb")).alias("d"), decode.deobfuscated(F.lit("powershell $x = 'y'")).alias("e"), decode.base64_text(F.lit("6QDoAOoA6wDpAOgA")).alias("f"),
    ).first()
    assert (row.a.decoded, row.a.techniques) == ("IEX($x)", ["base64 round 1", "evaluation"])
    assert row.b.decoded == '"calc" = \'calc\'; & "calc"; IEX ("calc")' and row.b.confidence == 0.25
    assert row.c.decoded == 'x = "Ab"' and row.c.confidence == 0.5
    assert row.e.kind == "script" or row.e.kind == "cipher"
    assert "rotation by 13" in row.d.techniques and row.f == "éèêëéè"


def test_event_xml_framing(spark, tmp_path):
    from tracemill.sources import windows_xml

    one = "<Event xmlns='u'><System><EventID>{}</EventID><Computer>h</Computer></System>\r\n<EventData><Data Name='CommandLine'>x &amp; y</Data></EventData></Event>\n"
    (tmp_path / "e.xml").write_text("<Events>" + "".join(one.format(k) for k in (1, 2, 3)) + "</Events>\n")
    found = windows_xml.events(windows_xml.records(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.event_id, r.command_line, r.source) for r in found] == [(str(k), "x & y", "WindowsEventLog") for k in (1, 2, 3)]


def test_empty_inputs(spark):
    events = sources.from_json_lines(lines(spark, []))
    assert rules.detect(events, [Rule("E", "e", "user", "x")]).count() == 0
    assert sessions.from_anchor(events, "user", 60).count() == 0


def test_stream_gives_each_finding_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in RECORDS[:2]) + "\n")
    found = detection.findings(detection.read_stream(spark, str(folder)), [Rule("E", "encoded", "command_line", "-enc", "contains")])
    query = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.rule_id for r in spark.table("found").collect()] == ["E"]


T0 = 1_704_067_200_000_000


def run_stream(spark, frame, name, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_of_sessions_and_parents(spark, tmp_path):
    rows = [(0, T0, "H", "4624", "0x1", None, None, ""), (1, T0 + 1_000_000, "h", "4647", "0x1", None, None, ""), (2, T0 + 2_000_000, "H", "4634", "0x1", None, None, ""), (3, T0 + 3_000_000, "H", "4688", None, 7, 1, "a.exe"), (4, T0 + 4_000_000, "h", "4688", None, 8, 7, "b.exe")]
    spark.createDataFrame(rows, "ord long, ts_us long, host string, event_id string, session string, child long, parent long, name string").write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "rows")).schema).parquet(str(tmp_path / "rows"))
    assert run_stream(spark, detection.sessions(stream), "logons", tmp_path) == [("h", "0x1", T0, T0 + 2_000_000, 3, True)]
    creations = stream.where("event_id = '4688'").select("ord", "ts_us", "host", "child", "parent", "name")
    assert run_stream(spark, detection.parents(creations), "parents", tmp_path) == [(4, T0 + 4_000_000, "h", "a.exe", 1_000_000)]


def test_rule_sets_and_limits(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert [r.id for r in rules.load_rules(str(tmp_path / "none"))] == ["R-ENC", "R-DL"]
    own = rules.authored_rule({"id": "X.1", "pattern": "a"})
    with pytest.raises(ValueError, match="twice"):
        rules.with_added([own], [rules.authored_rule({"id": "x.1", "pattern": "b"})])
    for bad in ({"id": "a b", "pattern": "x"}, {"id": "a", "pattern": "x" * 8001}, {"id": "a", "pattern": "x", "severity": "odd"}):
        with pytest.raises(ValueError):
            rules.authored_rule(bad)
    row = spark.range(1).select(rules.techniques_of(F.lit("R-ENC"), F.lit(" t1059.001")).alias("t")).first()
    assert row.t == ["T1059.001", "T1027.010"] and len(rules.tree_hash(str(tmp_path))) == 64


def test_demonstrations_and_adapters(spark, tmp_path):
    from tracemill.operators import reports, summaries
    from tracemill.sources import artifacts

    events = sources.from_json_lines(artifacts.demo_events(spark))
    found = rules.detect(events, [Rule("D", "download", "command_line", "curl", "contains", "high", "T1105")])
    told = {r.id: (r.n_events, r.n_hosts, r.n_findings) for r in artifacts.demo_summary(events, found).collect()}
    assert told == {"encoded_download": (2, 1, 1), "remote_service": (2, 2, 0), "plain_work": (1, 1, 0)}
    reports.write_html("Case", summaries.risk(found), found, events, str(tmp_path / "page"), rows=3)
    page = spark.read.option("wholetext", "true").text(str(tmp_path / "page")).first().value
    assert "<h1>Case</h1>" in page and "[REDACTED] http" in page
    record = json.dumps({"type": "sysmon", "host": "h", "@timestamp": "t", "data_model": {"object": "process", "action": ["other", "create"], "fields": {"Command_Line": "x", "md5_hash": "1", "utc_time": "u"}}})
    row = spark.range(1).select(artifacts.host_record(F.lit(record)).alias("r")).first().r
    assert (row.timestamp, row.event_id, row.command_line, row.hashes, row.event_data) == ("u", "1", "x", "MD5=1", {"CommandLine": "x"})
    nodes = json.dumps({"bsf": [{"id": "s", "nodetype": "step", "events": ["e1"], "techniques": [{"technique_id": "T1"}]}, {"id": "e1", "nodetype": "event", "host": "h", "time": "t"}, {"id": "e2", "nodetype": "event"}]})
    assert [tuple(r)[1:5] for r in artifacts.ground_truth(spark.createDataFrame([(1, nodes)], "record long, value string")).collect()] == [("s", "T1", "h", "t")]


def test_windows_xml_reads_each_record_once(spark):
    from tracemill.sources import windows_xml

    good = "<e:Event xmlns:e='u'><e:System><e:EventID>7</e:EventID></e:System><e:EventData><e:Data Name='a'>1</e:Data><e:Data Name='A'>2</e:Data><e:Data Name='a'>3</e:Data></e:EventData></e:Event>"
    frame = spark.createDataFrame([(1, good), (2, "<Event><Other/></Event>"), (3, "not xml"), (4, None)], "ord long, xml string").cache()
    read = windows_xml.events(frame)
    assert [(r.ord, r.event_id, json.loads(r.raw)["event_data"], json.loads(r.raw)["event_data_lists"]) for r in read.collect()] == [(1, "7", {"a": "1", "A": "2"}, {"a": ["1", "3"]})]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
