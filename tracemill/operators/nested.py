"""Hosts, users, sessions and record identities anywhere in nested records, as expressions over VARIANT.

A record is walked level by level to depth 4 within its own row: the nodes of a level are an array, and the
next one's are taken from it by functions of arrays, so nothing is exploded, shuffled or sent to Python.
Objects are nodes, whether fields of a node or members of a list that is one. Names are compared without case;
VARIANT keeps fields by name, so where one of several is chosen, order of names decides. A record that isn't
JSON, repeats a name in one object, or is null has empty scopes and no identity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T

DEPTH = 4
# Names of fields, and texts that name nobody.
HOSTS, USERS = ("host", "hostname", "computer", "computername"), ("user", "username")
HOST_PARTS, USER_PARTS = ("name", "hostname", "computer"), ("name", "username", "user")
TARGET, ALIASES, CONTEXTUAL = "targetlogonid", ("session_id", "sessionid"), ("subjectlogonid", "logonid", "logon_id")
NOBODY = ("unknown", "-", "none", "null")

def _texts() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:string>").isNotNull()


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def scalar(v: Column, lists: int = 2) -> Column:
    """A value as text; of lists, and lists in lists, the first text that isn't empty. Null for objects."""
    own = F.when(~_is_object(v), F.try_variant_get(v, "$", "string"))
    if not lists:
        return F.when(_members(v).isNull(), own)
    inner = lambda m: F.get(F.filter(F.transform(m, lambda x: scalar(x, lists - 1)), lambda s: s != ""), F.lit(0))
    return let(_members(v), lambda m: F.when(m.isNotNull(), inner(m)).otherwise(own))


def _fields(v: Column) -> Column:
    """(key, value) of an object's fields, names in lower case; none for anything else."""
    held = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    read = F.transform(held, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(read, F.array().cast("array<struct<key:string,value:variant>>"))


def _entries(v: Column) -> Column:
    """Fields also with their text, and whether they are objects."""
    return F.transform(_fields(v), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _is_object(e["value"]).alias("object"), scalar(e["value"]).alias("text")))


def _normal(text: Column) -> Column:
    return T.filled(F.lower(text))


def _part(v: Column, *names: str) -> Column:
    """The first of an object's fields (names as written) that holds a text."""
    return F.coalesce(*[F.nullif(scalar(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("")) for n in names])


def _session_text(text: Column) -> Column:
    return let(F.lower(text), T.session_id)


def _session(v: Column, lists: int = 2) -> Column:
    """A valid session's number; of a list, and of lists in it, the first valid one."""
    if not lists:
        return _session_text(scalar(v, 0))
    several = lambda m: F.get(F.filter(F.transform(m, lambda x: _session(x, lists - 1)), lambda s: s.isNotNull()), F.lit(0))
    return let(_members(v), lambda m: F.when(m.isNotNull(), several(m)).otherwise(_session_text(scalar(v, 0))))


def _named(entries: Column, names: Sequence[str]) -> Column:
    return F.filter(entries, lambda e: e["key"].isin(*names))


def _sessions(entries: Column, names: Sequence[str]) -> Column:
    """Valid sessions of fields; an object's is that of its id."""
    id_of = lambda e: F.when(e["object"], F.coalesce(*[F.try_variant_get(e["value"], f"$.{p}", "variant") for p in ("id", "session_id")])).otherwise(e["value"])
    return F.array_compact(F.transform(_named(entries, names), lambda e: let(id_of(e), lambda v: _session(v))))


def _authoritative(fields: Column) -> Column:
    """Where a target's logon is named, only that is a session, valid or not; else what is called one."""
    return F.when(F.size(_named(fields, (TARGET,))) > 0, _sessions(fields, (TARGET,))).otherwise(_sessions(fields, ALIASES))


def _canonical(entries: Column, part: str) -> Column:
    """The object ``part`` of each field ``canonical``."""
    own = F.transform(_named(entries, ("canonical",)), lambda e: F.try_variant_get(e["value"], f"$.{part}", "variant"))
    return F.filter(own, _is_object)


def _found_sessions(node: Column, entries: Column) -> Column:
    # The event data in a mapping and the mapping itself are two views of one record.
    fields = F.concat(entries, F.flatten(F.transform(_named(entries, ("event_data",)), lambda e: _entries(e["value"]))))
    claimed = F.array_compact(F.transform(_canonical(entries, "session"), lambda s: _session(F.try_variant_get(s, "$.id", "variant"))))

    def settled(f: Column) -> Column:
        agreed = lambda known: F.filter(claimed, lambda s: F.when(F.size(known) > 0, F.array_contains(known, s)).otherwise(~F.array_contains(_sessions(f, CONTEXTUAL), s)))
        return let(_authoritative(f), lambda known: F.concat(known, agreed(known)))

    own = F.when(node["event"], F.concat(_sessions(entries, (*ALIASES, TARGET)), claimed)).otherwise(let(fields, settled))
    return F.when(node["no_session"], _texts()).otherwise(own)


def _found_names(node: Column, entries: Column, kind: str) -> Column:
    names, parts, further = (HOSTS, HOST_PARTS, ("name",)) if kind == "host" else (USERS, USER_PARTS, ("name", "username"))
    own = F.transform(_named(entries, names), lambda e: _normal(F.when(e["object"], _part(e["value"], *parts)).otherwise(e["text"])))
    told = F.transform(_canonical(entries, kind), lambda c: _normal(_part(c, *further)))
    return F.when(node[f"no_{kind}"], _texts()).otherwise(F.array_compact(F.concat(own, told)))


def _says(entries: Column, names: Sequence[str], parts: Sequence[str]) -> Column:
    """Whether a field names a host or user in any of its parts."""
    meant = lambda s: F.coalesce(~s.isin(*NOBODY), F.lit(False))
    inner = lambda v: F.exists(F.array(*[_normal(scalar(F.try_variant_get(v, f"$.{p}", "variant"))) for p in parts]), meant)
    return F.exists(_named(entries, names), lambda e: F.when(e["object"], inner(e["value"])).otherwise(meant(_normal(e["text"]))))


def _node(v: Column, **flags: Column) -> Column:
    return F.struct(v.alias("v"), *[flags[n].alias(n) for n in ("event", "listed", "no_session", "no_host", "no_user", "path")])


def _children(node: Column, of_event: bool) -> Column:
    """The objects in a node's fields, each told what its parent has settled for it."""
    no = F.lit(False)

    def of(e: Column, i: Column, said: Column | None) -> Column:
        members = _members(e["value"])
        values = F.filter(F.coalesce(members, F.array(e["value"])), _is_object)
        raw = e["key"] == "raw"
        flags = {"no_session": node["no_session"] if of_event else node["no_session"] | (e["key"] == "event_data"), "no_host": node["no_host"], "no_user": node["no_user"]}
        if of_event:
            flags |= {"no_host": raw & said["host"], "no_user": raw & said["user"]}
        return F.transform(values, lambda v: _node(v, event=no, listed=node["listed"] | members.isNotNull(), path=F.concat(node["path"], F.array(-i)), **flags))

    if not of_event:
        return F.flatten(F.transform(_fields(node["v"]), lambda e, i: of(e, i, None)))
    says = let(_entries(node["v"]), lambda entries: F.struct(_says(entries, HOSTS, HOST_PARTS).alias("host"), _says(entries, USERS, USER_PARTS).alias("user")))
    return let(says, lambda said: F.flatten(F.transform(_fields(node["v"]), lambda e, i: of(e, i, said))))


def _nodes(records: DataFrame, column: str, events: bool) -> DataFrame:
    """The records with ``_nodes``: the objects of all levels."""
    no = F.lit(False)
    root = let(F.try_parse_json(column), lambda v: F.when(_is_object(v), F.array(_node(v, event=F.lit(events), listed=no, no_session=no, no_host=no, no_user=no, path=F.array().cast("array<int>")))))
    walked = records.withColumn("_0", root)
    below = lambda of_event: lambda node: _children(node, of_event)
    for k in range(DEPTH):
        walked = walked.withColumn(f"_{k + 1}", F.flatten(F.transform(f"_{k}", below(events and k == 0))))
    return walked.select(*[F.col(c) for c in records.columns], F.concat(*[F.col(f"_{k}") for k in range(DEPTH + 1)]).alias("_nodes"))


def _facts(n: Column, e: Column) -> list[Column]:
    return [_found_names(n, e, "host").alias("host"), _found_names(n, e, "user").alias("user"), _found_sessions(n, e).alias("session")]


def _listed(column: str) -> list[Column]:
    """Sorted distinct hosts, users and sessions of the nodes' facts."""
    none = _texts()
    return [F.array_sort(F.array_distinct(F.coalesce(F.flatten(F.col(f"{column}.{k}")), none))).alias(f"{k}s") for k in ("host", "user", "session")]


def scopes(records: DataFrame, column: str = "value", events: bool = True) -> DataFrame:
    """The records with sorted arrays ``hosts``, ``users`` and ``sessions``.

    With ``events`` a record's own fields are an event's: its sessions are taken as they are, and where it names
    its host or user, ``raw`` tells no other one. Otherwise a record is a mapping like those inside it: a target's
    logon is its session before any other, a subject's never, and a canonical session must agree with them.
    """
    told = _nodes(records, column, events).withColumn("_facts", F.transform("_nodes", lambda n: let(_entries(n["v"]), lambda e: F.struct(*_facts(n, e)))))
    return told.select(*[F.col(c) for c in records.columns], *_listed("_facts"))


def scopes_and_identity(records: DataFrame, column: str = "value", events: bool = True) -> DataFrame:
    """What :func:`scopes` and :func:`record_identity` add, from one walk through the records."""
    both = lambda n, e: F.struct(*_facts(n, e), F.when(~n["listed"], _identity(n, e)).alias("met"))
    told = _nodes(records, column, events).withColumn("_facts", F.transform("_nodes", lambda n: let(_entries(n["v"]), lambda e: both(n, e))))
    return told.select(*[F.col(c) for c in records.columns], *_listed("_facts"), *_first("_facts.met"))


def scope_rows(scoped: DataFrame, key: str) -> DataFrame:
    """Distinct (key, kind, value) of :func:`scopes`: what the members of a chain name, if ``key`` is the chain."""
    told = lambda kind: F.transform(f"{kind}s", lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    pairs = [told(kind) for kind in ("host", "user", "session")]
    return scoped.select(key, F.inline(F.concat(*pairs))).distinct()


def _identity(node: Column, entries: Column) -> Column:
    def held(entries: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.get(_named(entries, (n,)), F.lit(0))["text"], F.lit("")) for n in names])

    def pair(entries: Column, *ids: str) -> Column:
        found = F.struct(F.trim(held(entries, "channel")).alias("channel"), F.trim(held(entries, *ids)).alias("record_id"))
        return F.when((found["channel"] != "") & (found["record_id"] != ""), found)

    own = pair(entries, "eventrecordid", "event_record_id")
    system = let(_entries(F.get(_named(entries, ("system",)), F.lit(0))["value"]), lambda s: pair(s, "eventrecordid", "event_record_id", "record_id"))
    return F.struct(node["path"].alias("path"), F.coalesce(system, own).alias("id"))


def _first(column: str) -> list[Column]:
    """``channel`` and ``record_id`` of the first identity by path."""
    first = F.array_min(F.filter(column, lambda m: m["id"].isNotNull()))["id"]
    return [first["channel"].alias("channel"), first["record_id"].alias("record_id")]


def record_identity(records: DataFrame, column: str = "value") -> DataFrame:
    """The records with ``channel`` and ``record_id``: those of the first object in depth-first order, the last field first, that has both.

    ``record_id`` counts as the number of a record only within ``System``. Lists aren't entered.
    """
    nodes = F.filter("_nodes", lambda n: ~n["listed"])
    met = _nodes(records, column, False).withColumn("_met", F.transform(nodes, lambda n: let(_entries(n["v"]), lambda e: _identity(n, e))))
    return met.select(*[F.col(c) for c in records.columns], *_first("_met"))
