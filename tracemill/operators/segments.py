"""Running values along the ordered rows of each key, however many of all rows one key has.

A window sorts the rows of one key in one task. Here that holds only for keys with fewer rows than a mean
task; the others are dealt by range of key and order, so that a busy key lies in as many blocks as its rows
ask for. A block acts on a running value as one function: sums add, a latest value replaces, an anchor goes
to the last anchor that follows from it. The functions of a key's blocks are composed in their order, one
row per block and key, and what comes into each block is then applied to its rows, all blocks at once.

Blocks are stored before use, as the bounds of ranges are drawn anew each time that they are worked out.
Keys are compared as they are, null with null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: A key of fewer rows is no burden to one task, whatever its share.
LEAST = 200_000
SECOND = 1_000_000


class Fold(NamedTuple):
    """``sum``, ``max`` or ``last`` (not null) of the rows before, ``first`` (not null) of those after, or ``total`` of all rows of the key."""

    kind: str
    value: Column
    own: bool = True  # whether the row itself counts


def split(rows: DataFrame, keys: Sequence[str], least: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of keys with more rows than a mean task, or None if there are none.

    At most as many keys as tasks can be so busy, so they are told apart by broadcast.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    large = tables.store(counts.where(F.col("n") > (LEAST if least is None else least)).select(*named, "n"), "large-keys")
    if large.isEmpty():
        tables.discard(large)
        return rows, None
    busy = large.where(F.col("n") > rows.count() / tasks).drop("n")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return rows.join(F.broadcast(busy), on, "left_anti"), rows.join(F.broadcast(busy), on, "left_semi")


def blocks_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt by range of keys and order, with the number of their range in ``_block``; stored."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return tables.store(dealt.withColumn("_block", F.spark_partition_id()), "blocks")


def _over(keys: Sequence[str], order: Sequence[str], fold: Fold) -> Column:
    line = Window.partitionBy(*keys)
    if fold.kind == "total":
        return F.sum(fold.value).over(line)
    # Seen from the end the rows after a row are those before it, for which a window keeps one running value.
    line = line.orderBy(*[F.col(c).desc_nulls_last() if fold.kind == "first" else F.col(c).asc_nulls_first() for c in order])
    line = line.rowsBetween(Window.unboundedPreceding, 0 if fold.own else -1)
    if fold.kind in ("first", "last"):
        return F.last(fold.value, ignorenulls=True).over(line)
    return {"sum": F.sum, "max": F.max}[fold.kind](fold.value).over(line)


def _of_block(order: Sequence[str], fold: Fold) -> Column:
    if fold.kind in ("sum", "total"):
        return F.sum(fold.value)
    if fold.kind == "max":
        return F.max(fold.value)
    pick = F.max_by if fold.kind == "last" else F.min_by
    return pick(fold.value, F.when(fold.value.isNotNull(), F.struct(*order)))


def _joined(fold: Fold, local: Column, carried: Column) -> Column:
    if fold.kind == "total":
        return carried
    if fold.kind == "max":
        return F.greatest(local, carried)
    if fold.kind == "sum":
        return F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(local + carried)
    return F.coalesce(local, carried)


class Line:
    """Rows with running values by key; each :meth:`fold` adds columns that the next may use."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], least: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self._plain, busy = split(rows, self.keys, least)
        self._blocks = None if busy is None else blocks_of(busy, self.keys, self.order)

    def fold(self, **folds: Fold) -> Line:
        new = object.__new__(Line)
        new.keys, new.order = self.keys, self.order
        new._plain = self._plain.select("*", *[_over(self.keys, self.order, f).alias(name) for name, f in folds.items()])
        new._blocks = None if self._blocks is None else self._over_blocks(folds)
        return new

    def _over_blocks(self, folds: dict[str, Fold]) -> DataFrame:
        rows = self._blocks
        acted = rows.groupBy("_block", *self.keys).agg(*[_of_block(self.order, f).alias(f"_in_{name}") for name, f in folds.items()])
        coming = [_over(self.keys, ["_block"], Fold(f.kind, F.col(f"_in_{name}"), f.kind == "total")).alias(f"_in_{name}") for name, f in folds.items()]
        renamed = [F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]
        carried = acted.select(F.col("_block").alias("_of"), *renamed, *coming)  # two rows per block or so: busy keys only
        on = F.col("_block") == F.col("_of")
        for i, k in enumerate(self.keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
        local = rows.select("*", *[_over(["_block", *self.keys], self.order, f).alias(f"_own_{name}") for name, f in folds.items() if f.kind != "total"])
        done = [_joined(f, F.col(f"_own_{name}") if f.kind != "total" else F.lit(None), F.col(f"_in_{name}")).alias(name) for name, f in folds.items()]
        return local.join(F.broadcast(carried), on).select(*rows.columns, *done)

    def rows(self) -> DataFrame:
        return self._plain if self._blocks is None else self._plain.unionByName(self._blocks.drop("_block"))


def greedy(times: np.ndarray, reach: int, anchor: int | None = None) -> np.ndarray:
    """The anchor of each of some ascending instants: the first one later than ``reach`` after an anchor is the next anchor."""
    found = np.empty(len(times), np.int64)
    i = 0 if anchor is None else int(np.searchsorted(times, anchor + reach, "right"))
    found[:i] = anchor if anchor is not None else 0
    then = np.searchsorted(times, times + reach, "right")
    while i < len(times):
        found[i : then[i]] = times[i]
        i = int(then[i])
    return found


def anchor_function(times: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block makes of the anchor that comes into it, as (until, last).

    An anchor a becomes the last of the first ``until`` above a + reach, and stays if none is above. All first
    instants that lead to the same last anchor are one entry; after a few steps most chains have met.
    """
    times = np.unique(times)
    first = times[: int(np.searchsorted(times, times[0] + reach, "right")) + 1]
    then = np.searchsorted(times, times + reach, "right")
    last = np.where(then < len(times), then, np.arange(len(times)))
    while not np.array_equal(last[last], last):
        last = last[last]
    ends = times[last[: len(first)]]
    change = np.append(ends[1:] != ends[:-1], True)
    return first[change], ends[change]


def _streamed(key: str, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor = None, None
        for batch in batches:
            keys, times = batch.column(0), batch.column(2).to_numpy()
            starts = [0]
            if len(batch) > 1:
                differ = pa.compute.or_kleene(pa.compute.not_equal(keys[1:], keys[:-1]).fill_null(False), pa.compute.not_equal(keys[1:].is_null(), keys[:-1].is_null()))
                starts += (np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1).tolist()
            anchors = np.empty(len(times), np.int64)
            for a, b in zip(starts, [*starts[1:], len(times)]):
                own = (keys[a].as_py(),)
                anchors[a:b] = greedy(times[a:b], reach, anchor if own == held else None)
                if b > a:
                    held, anchor = own, int(anchors[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors)], names=[key, "ord", "ts_us", "anchor_us"])

    return run


def anchored(rows: DataFrame, key: str, seconds: int, least: int | None = None) -> DataFrame:
    """(key, ord, ts_us, anchor_us): each event with the instant of its segment's first one, which reaches ``seconds`` from it.

    An ordinary key streams through one task, in the order of time. Of a busy key every block is a function of
    the anchor that comes in; the functions, whose size is the number of different anchors that they lead to,
    are applied one after another in a stream.
    """
    reach, kind = seconds * SECOND, dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, ord bigint, ts_us bigint, anchor_us bigint"
    plain, busy = split(rows.select(key, "ord", "ts_us"), [key], least)
    done = plain.repartition(key).sortWithinPartitions(key, "ts_us", "ord").mapInArrow(_streamed(key, reach), schema)
    if busy is None:
        return done
    blocks = blocks_of(busy, [key], ["ts_us", "ord"])

    def function(frame: pd.DataFrame) -> pd.DataFrame:
        until, last = anchor_function(np.sort(frame["ts_us"].to_numpy()), reach)
        return pd.DataFrame({"_block": [frame["_block"].iloc[0]], key: [frame[key].iloc[0]], "first_us": [frame["ts_us"].min()], "until": [until], "last": [last]})

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor = None, None
        for batch in batches:
            coming = []
            for k, first, until, last in zip(*(batch.column(c).to_pylist() for c in (key, "first_us", "until", "last"))):
                anchor = anchor if (k,) == held else None
                coming.append(anchor)
                at = int(np.searchsorted(until, first - 1 if anchor is None else anchor + reach, "right"))
                held, anchor = (k,), last[at] if at < len(until) else anchor
            yield pa.RecordBatch.from_arrays([batch.column("_block"), batch.column(key), pa.array(coming, pa.int64())], names=["_of", "_key", "coming"])

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts_us", "ord"], ignore_index=True)
        coming = frame["coming"].iloc[0]
        return frame[[key, "ord", "ts_us"]].assign(anchor_us=greedy(frame["ts_us"].to_numpy(), reach, None if pd.isna(coming) else int(coming)))

    functions = blocks.groupBy("_block", key).applyInPandas(function, f"_block int, `{key}` {kind}, first_us bigint, until array<bigint>, last array<bigint>")
    carried = functions.repartition(key).sortWithinPartitions(key, "_block").mapInArrow(compose, f"_of int, _key {kind}, coming bigint")
    carried = tables.store(carried, "anchors")
    on = (F.col("_block") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    return done.unionByName(blocks.join(F.broadcast(carried), on).groupBy("_block", key).applyInPandas(apply, schema))
