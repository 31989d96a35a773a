"""Correlation in time: interval, as-of and multi-way joins, and confidence of the chains that they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import SECOND, Fold, Line


def fits(patterns: Sequence[str]) -> Column:
    """Whether an event fits a pattern: ``event_id:`` in full, ``cmd:`` within its command line, ``source:`` or none within its source."""
    found = F.lit(False)
    for pattern in patterns:
        prefix, sign, rest = pattern.partition(":")
        name = {"source": "source", "event_id": "event_id", "cmd": "command_line"}.get(prefix) if sign else None
        column, wanted = F.col(name or "source"), rest if name else pattern
        held = (column == wanted) if name == "event_id" else F.contains(F.lower(column), F.lit(wanted.lower()))
        found = found | F.coalesce(held & (column != ""), F.lit(False))
    return found


def interval_join(first: DataFrame, second: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Pairs of a first event and a later second one within ``seconds``, equal in ``keys``.

    Columns are prefixed ``a_`` and ``b_``. Both sides are cut in time slots of the window's length, and each
    first event goes to its own slot and the next: an equi-join on keys and slot, whose partitions stay
    small however many events a key has, also without any key. Null and empty keys join nothing.
    """
    width = seconds * SECOND
    slot = F.floor(F.col("ts_us") / width)
    present = F.lit(True)
    for k in keys:
        present = present & (F.col(k) != "")
    a = first.where(present & F.col("ts_us").isNotNull()).withColumn("slot", F.explode(F.array(slot, slot + 1)))
    b = second.where(present & F.col("ts_us").isNotNull()).withColumn("slot", slot)
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = F.col("a_slot") == F.col("b_slot")
    for k in keys:
        on = on & (F.lower(f"a_{k}") == F.lower(f"b_{k}"))
    later = F.struct("b_ts_us", "b_ord") > F.struct("a_ts_us", "a_ord")
    return a.join(b, on & later & (F.col("b_ts_us") <= F.col("a_ts_us") + width)).drop("a_slot", "b_slot")


def chains(pairs: DataFrame) -> DataFrame:
    """One chain per first event: its size and the span from it to its last event, in microseconds."""
    return pairs.groupBy("a_ord").agg((F.count("*") + 1).alias("n_events"), (F.max("b_ts_us") - F.min("a_ts_us")).alias("span_us"))


def chain_confidence(n_events: Column, span_us: Column, weight: Column, n_findings: Column) -> Column:
    """0.3, more for a short (but not zero) span, severe findings, many events and many findings; at most 1.

    ``weight`` is the sum over findings of ``severity_weight``.
    """
    time = F.when(span_us == 0, 0.0).when(span_us < 60 * SECOND, 0.2).when(span_us < 300 * SECOND, 0.1).when(span_us < 600 * SECOND, 0.05).otherwise(0.0)
    size = F.when(n_events >= 3, F.least(F.lit(0.2), F.ln(n_events + 1) * 0.05)).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.3) + time + weight + size + F.least(F.lit(0.1), n_findings * 0.02))


def severity_weight(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "high"), 0.2).when(low == "medium", 0.1).otherwise(0.05)


def as_of_parent(created: DataFrame, key: Sequence[str], child: str, parent: str, name: str, seconds: int = 300, least: int | None = None) -> DataFrame:
    """Each row with the name of the latest earlier row (by ``ord``) whose ``child`` id is its ``parent`` id.

    The match counts only at an age from 0 to ``seconds``. Both roles of a row are one line by key and id,
    with a running last value; a busy id is cut in blocks (``segments``). Rows without a parent id match nothing.
    """
    lower = [F.lower(k).alias(f"_key{i}") for i, k in enumerate(key)]
    none = F.lit(None).cast(f"struct<ts_us:bigint,name:{dict(created.dtypes)[name]}>")
    own = created.where(F.col(parent).isNotNull()).select(*created.columns, *lower, F.lit(1).alias("role"), F.col(parent).alias("pid"), none.alias("made"))
    maker = created.where(F.col(child).isNotNull() & F.col("ts_us").isNotNull() & (F.coalesce(name, F.lit("")) != ""))
    empty = [F.lit(None).cast(t).alias(c) for c, t in created.dtypes if c not in ("ord", "ts_us")]
    made = maker.select("ord", "ts_us", *empty, *lower, F.lit(2).alias("role"), F.col(child).alias("pid"), F.struct("ts_us", F.col(name).alias("name")).alias("made"))
    line = Line(own.unionByName(made), [f"_key{i}" for i in range(len(key))] + ["pid"], ["ord", "role"], least).fold(seen=Fold("last", F.col("made"), own=False))
    age = F.col("ts_us") - F.col("seen.ts_us")
    ok = age.between(0, seconds * SECOND)
    joined = line.rows().where("role = 1").select(*created.columns, F.when(ok, F.col("seen.name")).alias("parent_name"), F.when(ok, age).alias("parent_age_us"))
    return joined.unionByName(created.where(F.col(parent).isNull()), allowMissingColumns=True)


def first_within(left: DataFrame, right: DataFrame, keys: Sequence[str], before: int, after: int, alias: str) -> DataFrame:
    """Left rows with the order number of the first right row from ``before`` seconds earlier to ``after`` seconds later, if any.

    Slots as in ``interval_join``; the aggregation by left row is partial, so many candidates fold early.
    """
    width = (before + after) * SECOND
    start = F.col("ts_us") - before * SECOND
    slot = F.floor(start / width)
    a = left.select("ord", "ts_us", *keys, F.explode(F.array(slot, slot + 1)).alias("slot"))
    b = right.select(F.col("ord").alias("r_ord"), F.col("ts_us").alias("r_us"), *[F.col(k).alias(f"r_{k}") for k in keys], F.floor(F.col("ts_us") / width).alias("r_slot"))
    on = (F.col("slot") == F.col("r_slot")) & F.col("r_us").between(start, F.col("ts_us") + after * SECOND)
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    found = a.join(b, on).groupBy("ord").agg(F.min_by("r_ord", F.struct("r_us", "r_ord")).alias(alias))
    return left.join(found, "ord", "left")
