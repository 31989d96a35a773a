"""Three cuts of a timeline: by gap, from an anchor, and by opening and closing events. A busy key is cut in blocks, see ``segments``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments
from .segments import SECOND, Fold, Line


def by_gap(events: DataFrame, key: str, seconds: int, least: int | None = None) -> DataFrame:
    """Events with the number of their session, from 1: a new one starts after a gap of more than ``seconds``."""
    line = Line(events, [key], ["ts_us", "ord"], least).fold(_before=Fold("last", F.col("ts_us"), own=False))
    starts = F.col("_before").isNull() | (F.col("ts_us") - F.col("_before") > seconds * SECOND)
    return line.fold(session=Fold("sum", starts.cast("long"))).rows().drop("_before")


def from_anchor(events: DataFrame, key: str, seconds: int, least: int | None = None) -> DataFrame:
    """Events (key, ord, ts_us) with the instant of their segment's first event, which reaches ``seconds`` from it.

    A greedy cut that no window frame expresses; events without an instant have no segment.
    """
    return segments.anchored(events.where("ts_us IS NOT NULL"), key, seconds, least)


def by_lifecycle(events: DataFrame, key: str, opens: Column, closes: Column, least: int | None = None) -> DataFrame:
    """Events from an opening one to the first closing one, with the session's number; others belong to none."""
    marked = events.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_mark", F.when(closes, False).when(F.col("_opens"), True))
    line = Line(marked, [key], ["ts_us", "ord"], least).fold(session=Fold("sum", F.col("_opens").cast("long")), _open=Fold("last", F.col("_mark"), own=False))
    return line.rows().where(F.col("_opens") | ((F.col("session") > 0) & F.col("_open"))).drop("_opens", "_mark", "_open")
