"""Scopes and identities in nested records against a recursion over the same records."""

import json
import random

import pytest

from tracemill.operators import nested


def folded(m):
    return {k.lower(): v for k, v in m.items()}


def first_text(v):
    if isinstance(v, list):
        return next((s for s in map(first_text, v) if s not in (None, "")), None)
    return None if isinstance(v, dict) or v is None else v if isinstance(v, str) else json.dumps(v)


def name(v):
    s = first_text(v)
    return s.strip().lower() or None if s is not None else None


def part(m, *names):
    return next((s for s in (first_text(m.get(n)) for n in names) if s not in (None, "")), None)


def session(v, listed=False):
    if isinstance(v, dict) and listed:
        return None
    if isinstance(v, dict):
        v = v["id"] if v.get("id") is not None else v.get("session_id")
    if isinstance(v, list):
        return next((s for s in (session(x, True) for x in v) if s), None)
    s = name(v)
    if s and s.startswith("0x"):
        try:
            s = hex(int(s[2:], 16)) if all(c in "0123456789abcdef" for c in s[2:]) and s[2:] else None
        except ValueError:
            s = None
    return None if s in ("0", "0x0", "-", "none", "null", None) else s


def views(m):
    data = folded(m).get("event_data")
    return [folded(m)] + ([folded(data)] if isinstance(data, dict) else [])


def settled(m):
    names = ("targetlogonid",) if any("targetlogonid" in f for f in views(m)) else ("session_id", "sessionid")
    return {s for f in views(m) for n in names if n in f for s in [session(f[n])] if s}


def walk(m, event, depth, off, out):
    if depth > 4:
        return
    f, every = folded(m), [(k.lower(), v) for k, v in m.items()]
    says = lambda names, parts: any(k in names and any((name(x) or "none") not in nested.NOBODY for x in ([v.get(p) for p in parts] if isinstance(v, dict) else [v])) for k, v in every)
    add = lambda kind, value: value and kind not in off and out[kind].add(value)
    for s in [session(f[n]) for n in ("session_id", "sessionid", "targetlogonid") if n in f] if event else settled(m):
        add("sessions", s)
    for kind, names, parts in (("hosts", nested.HOSTS, nested.HOST_PARTS), ("users", nested.USERS, nested.USER_PARTS)):
        for n, v in every:
            if n in names:
                add(kind, name(part(v, *parts) if isinstance(v, dict) else v))
    own = f.get("canonical")
    if isinstance(own, dict):
        for kind, n, parts in (("hosts", "host", ("name",)), ("users", "user", ("name", "username"))):
            if isinstance(own.get(n), dict):
                add(kind, name(part(own[n], *parts)))
        if isinstance(own.get("session"), dict) and (s := session(own["session"].get("id"))):
            known = settled(m)
            barred = {session(v[n]) for v in views(m) for n in nested.CONTEXTUAL if n in v}
            if event or (s in known if known else s not in barred):
                add("sessions", s)
    for k, v in every:
        for child in v if isinstance(v, list) else [v]:
            if isinstance(child, dict):
                less = {"sessions"} if not event and k == "event_data" else set()
                if event and k == "raw":
                    less |= {"hosts"} if says(nested.HOSTS, nested.HOST_PARTS) else set()
                    less |= {"users"} if says(nested.USERS, nested.USER_PARTS) else set()
                walk(child, False, depth + 1, off | less, out)


def plain(text, event):
    out = {"hosts": set(), "users": set(), "sessions": set()}
    try:
        m = json.loads(text or "")
    except ValueError:
        m = None
    if isinstance(m, dict):
        walk(m, event, 0, set(), out)
    return tuple(sorted(out[k]) for k in ("hosts", "users", "sessions"))


def drawn(r, depth=0):
    values = ["H1", " h2 ", "", "-", "unknown", None, 7, True, "0x00A", "0xZZ", "0x0", "12", ["", None, "L1"], [["", "L2"]], []]
    objects = ["event", "raw", "canonical", "event_data", "members", "host", "user", "session", "other", "TargetLogonId"]
    m = {}
    for k in r.sample(["Host", "hostName", "user", "UserName", "session_id", "SessionId", "TargetLogonId", "SubjectLogonId", "logon_id", "name", "id", "username", "computer", "x"], r.randrange(5)):
        m[k] = r.choice(values)
    if depth < 6:
        for k in r.sample(objects, r.randrange(4)):
            if k.lower() not in folded(m):
                child = drawn(r, depth + 1)
                m[k] = r.choice([child, child, [child, "text", drawn(r, depth + 1)], [[child]]])
    return m


@pytest.mark.parametrize("event", [True, False])
def test_same_as_recursion(spark, event):
    r = random.Random(5)
    texts = [json.dumps(drawn(r)) for _ in range(600)] + ["[1]", "x", "", None, '"t"', '{"a":1,"a":2}', "{}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "ord long, value string")
    found = {x.ord: (x.hosts, x.users, x.sessions) for x in nested.scopes(frame, events=event).collect()}
    assert len(found) == len(texts)
    wrong = [(texts[i], found[i], plain(texts[i], event)) for i in found if tuple(map(list, found[i])) != plain(texts[i], event)]
    assert not wrong, wrong[:2]
    assert sum(any(f) for f in found.values()) > 300


def identity(m):
    stack = [m]
    while stack:
        at = stack.pop()
        f = folded(at)
        held = lambda g, *names: next((s.strip() for s in (first_text(g.get(n)) for n in names) if s), "")
        inner = folded(f["system"]) if isinstance(f.get("system"), dict) else {}
        for pair in ((held(inner, "channel"), held(inner, "eventrecordid", "event_record_id", "record_id")), (held(f, "channel"), held(f, "eventrecordid", "event_record_id"))):
            if all(pair):
                return pair
        stack.extend(v for _, v in sorted(at.items()) if isinstance(v, dict))
    return None, None


def test_identity_in_order(spark):
    r = random.Random(3)

    def record(depth=0):
        m = {k: r.choice(["C1", "C2", "", 5, None]) for k in r.sample(["Channel", "EventRecordID", "event_record_id", "record_id"], r.randrange(4))}
        for k in r.sample(["System", "raw", "Event", "a", "z"], r.randrange(4) if depth < 4 else 0):
            m[k] = record(depth + 1)
        return m

    records = [record() for _ in range(400)]
    frame = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(records)], "ord long, value string")
    found = {x.ord: (x.channel, x.record_id) for x in nested.record_identity(frame).collect()}
    assert found == {i: identity(m) for i, m in enumerate(records)} and sum(c is not None for c, _ in found.values()) > 100
