"""Removal of long repeated byte strings, exactly, by blockwise sorting of suffixes with cover ranks.

Only suffixes that agree over ``length`` bytes matter, so the order is built just as far as that:

* Cover: of the ``GRAM``-byte strings that start in a window of ``length`` bytes, the one with the least
  hash is the window's sample. Equal windows have their sample at the same offset, which is what a
  difference cover is for; a periodic cover would give it for unequal ones as well, at several samples a
  suffix instead of one.
* Buckets: suffixes that start at most ``CELL - 1`` bytes before an anchor (the sample, or ``CELL`` bytes
  before it) hold the same ``length - CELL + 1`` bytes from there if they are equal. A bucket is all
  suffixes with one name of those bytes. Names are hashes and only say what can't be equal: buckets with
  one anchor go first, and no result rests on a name.
* Blocks: one bucket at a time, its anchors' suffixes are sorted on their bytes (by Spark, which spills),
  which gives each a rank and the bytes it shares with its neighbour. Two suffixes ``r`` bytes before
  their anchors are equal if those ``r`` bytes are, and if no neighbour between their anchors' ranks
  shares fewer than ``length - r``. So long ties cost one look at ranks, and no suffix is ever copied.

Anchors with the same bytes all around are told by a 128-bit digest and stand in the sort as one row with
a count, so a passage that a third of all documents share is folded before it is sorted. They repeat by
that count alone. Buckets with more than ``CROWD`` different rows are not sorted in one task: each of
their windows is told from the others by its own 128-bit digest, spread over all tasks.

Superseded tables are deleted, and the shuffles of a stored table go once it is written.

Defined cases: null text reads as empty; texts shorter than ``length`` bytes lose nothing; repeated rows,
ties included, are occurrences of their own, so all copies of a text of at least ``length`` bytes lose
everything, whatever their ids (null ids too); an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, store, text_of
from .near_duplicates import mix

LENGTH, GRAM, CROWD = 200, 64, 50_000
_SPAN = 1 << 19  # bytes of text taken at a time
_BASE = np.uint64(0x2545F4914F6CDD1D)
_LOW = np.uint64((1 << 20) - 1)
#: A row's number is its partition (20 bits) and its place there (22 bits).
_PLACE_BITS = 22
_SEEN = 200_000  # contexts that a task remembers having sent


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, and the powers of the base and of its inverse."""
    n = _SPAN + 1024
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)])) for b in (_BASE, inverse)]
    return np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), *powers


class Names:
    """Names of any substrings of one piece of text, in constant time each."""

    def __init__(self, data: np.ndarray):
        table, powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def cell_width(length: int = LENGTH, gram: int = GRAM) -> int:
    """Half of the places that a sample can have in a window."""
    return (length - gram + 2) // 2


def _pack(start: np.ndarray, windows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A run of window starts and how far its anchor lies behind the first, in one long."""
    return start.astype(np.int64) << 16 | windows.astype(np.int64) << 8 | before.astype(np.int64)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if width > have else key


def cells(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, before, bucket) of the runs of windows with one anchor, in texts laid end to end; none crosses an end."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    names, width = Names(data), cell_width(length, gram)
    # The place in the low bits breaks ties of equal grams from the left, alike in equal windows.
    key = (names.all(gram) & ~_LOW) | np.arange(len(data) - gram + 1, dtype=np.uint64)
    sample = (_least(key, length - gram + 1) & _LOW).astype(np.int64)
    start = np.arange(len(sample))
    cell = (sample - start) // width
    inside = np.ones(len(sample), bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (sample[1:] != sample[:-1]) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    anchor = sample[first] - cell[first] * width
    bucket = mix(names.of(anchor, length - width + 1) + cell[first].astype(np.uint64))
    return first, last - first + 1, anchor - first, bucket


def _cells_of(raw: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, bucket) of all runs in all texts, in order; long texts in pieces, short ones many at a time."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(texts: list[int], data: bytes, at: int) -> None:
        bounds = np.cumsum([0, *[len(data) if len(texts) == 1 else len(raw[t]) for t in texts]])
        start, windows, before, bucket = cells(np.frombuffer(data, np.uint8), bounds[1:], length, gram)
        which = np.searchsorted(bounds, start, "right") - 1
        found.append((np.array(texts, np.int64)[which], _pack(start - bounds[which] + at, windows, before), bucket))

    group, size = [], 0
    for t, data in enumerate(raw):
        if len(data) < length:
            continue
        if group and size + len(data) > _SPAN:
            take(group, b"".join(raw[g] for g in group), 0)
            group, size = [], 0
        if len(data) > _SPAN:
            for at in range(0, len(data) - length + 1, _SPAN - length + 1):
                take([t], data[at : at + _SPAN], at)
        else:
            group.append(t)
            size += len(data)
    if group:
        take(group, b"".join(raw[g] for g in group), 0)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                raw = [t.encode("utf-8", "replace") for t in part.column("text").to_pylist()]
                text, place, bucket = _cells_of(raw, length, gram)
                ends = pa.array(np.searchsorted(text, np.arange(len(raw) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, bucket.view(np.int64))]
                digests = pa.array([hashlib.sha256(d).hexdigest() for d in raw])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("row", "doc_id", "text")], pa.array([len(d) for d in raw], pa.int64()), digests, *lists],
                    names=["row", "doc_id", "text", "n_bytes", "sha256", "place", "bucket"],
                )

    return run


def _contexts(length: int):
    """For each run its digest and, once a task, the bytes before its anchor (from the anchor back) and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for k in range(len(batch)):
                data = batch.column("text")[k].as_py().encode("utf-8", "replace")
                asked = batch.column("asked")[k].values
                place = asked.field("place").to_numpy()
                digests, heads, tails = [], [], []
                for p in place.tolist():
                    start, windows, before = p >> 16, p >> 8 & 255, p & 255
                    whole = data[start : start + windows - 1 + length]
                    digest = hashlib.blake2b(whole, digest_size=16, salt=p.to_bytes(8)[-2:]).digest()
                    new = digest not in seen
                    digests.append(digest)
                    heads.append(whole[:before][::-1] if new else None)
                    tails.append(whole[before:] if new else None)
                    seen.add(digest)
                if len(seen) > _SEEN:
                    seen = set()
                rows = pa.array(np.full(len(place), batch.column("row")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([rows, pa.array(place), asked.field("bucket"), pa.array(digests, pa.binary()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], names=["row", "place", "bucket", "digest", "head", "tail"])

    return run


def _padded(texts: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), np.uint8).reshape(len(texts), size)


def _shared(rows: np.ndarray, same_bucket: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; -1 at the first of a bucket."""
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[-1], np.where(same_bucket, shared, -1)])


def repeated_windows(bucket: np.ndarray, head: list[bytes], tail: list[bytes], place: np.ndarray, times: np.ndarray, length: int, width: int) -> np.ndarray:
    """(row, window) flags of rows sorted by (bucket, tail): whether the window's bytes stand in the bucket more than once."""
    n, (_, windows, before) = len(bucket), _unpack(place)
    by_tail = _shared(_padded(tail, length), bucket[1:] == bucket[:-1])
    heads = _padded(head, max(1, width - 1))
    number = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
    order = np.lexsort((np.ascontiguousarray(heads).view(f"S{heads.shape[1]}").ravel(), number))
    by_head = _shared(heads[order], number[order][1:] == number[order][:-1])
    flags = np.zeros((n, width), bool)
    head_class = np.empty(n, np.int64)
    for r in range(width):
        own = np.flatnonzero((before - windows < r) & (r <= before))
        if not len(own):
            continue
        head_class[order] = np.cumsum(by_head < r)
        both = np.cumsum(by_tail < length - r)[own] * (n + 1) + head_class[own]
        _, which = np.unique(both, return_inverse=True)
        flags[own, before[own] - r] = np.bincount(which, weights=times[own])[which] > 1
    return flags


def _runs(flags: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(row, place) of each run of flagged windows."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    at, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    found = _pack((place[at] >> 16) + first, last - first, np.zeros(len(at), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(found)], names=["row", "place"])


def _rank(length: int, width: int):
    """Runs of repeated windows of the rows that stand once, from rows sorted by (bucket, tail)."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        bucket, row, place, times = (table.column(c).to_numpy() for c in ("bucket", "row", "place", "times"))
        flags = repeated_windows(bucket, table.column("head").to_pylist(), table.column("tail").to_pylist(), place, times, length, width)
        once = times == 1
        return _runs(flags[once], row[once], place[once])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # All rows of a batch's last bucket wait for the next one; no bucket has more than CROWD.
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if held and held[-1].column("bucket")[-1].as_py() != bucket[-1] or cut:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _windows(length: int):
    """(digest, row, place) of every single window of the rows of crowded buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                whole = batch.column("head")[k].as_py()[::-1] + batch.column("tail")[k].as_py()
                place = batch.column("place")[k].as_py()
                start, windows = place >> 16, place >> 8 & 255
                digests = [hashlib.blake2b(whole[i : i + length], digest_size=16).digest() for i in range(windows)]
                fixed = [pa.array(np.full(windows, batch.column(c)[k].as_py(), np.int64)) for c in ("row", "times")]
                places = _pack(np.arange(start, start + windows), np.ones(windows, np.int64), np.zeros(windows, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), fixed[0], pa.array(places), fixed[1]], names=["digest", "row", "place", "times"])

    return run


def _settled(found: DataFrame, length: int, width: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """(row, place) of all runs of repeated windows, and the tables that it reads; ``found``: stored runs with digests and contexts."""
    witness = F.min(F.when(F.col("tail").isNotNull(), F.struct("row", "place"))).alias("w")
    kinds = store(found.groupBy("bucket", "digest").agg(F.count(F.lit(1)).alias("times"), witness), "kinds")
    again = found.select("row", "place", "bucket", "digest").join(kinds.where("times > 1").select("bucket", "digest"), ["bucket", "digest"]).select("row", "place")
    shape = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("times").alias("least"))
    mixed = store(shape.where("rows > 1 AND least = 1").select("bucket", (F.col("rows") > crowd).alias("crowded")), "mixed")
    asked = kinds.join(mixed, "bucket").select("w.row", "w.place", "bucket", "digest", "times", "crowded")
    asked = store(asked, "witnesses")
    rows = store(found.join(asked, ["row", "place", "bucket", "digest"]).select("bucket", "head", "tail", "row", "place", "times", "crowded"), "rows")
    sorted_rows = rows.where("NOT crowded").drop("crowded").repartition("bucket").sortWithinPartitions("bucket", "tail")
    ranked = sorted_rows.mapInArrow(_rank(length, width), "row long, place long")
    single = rows.where("crowded").select("head", "tail", "row", "place", "times").mapInArrow(_windows(length), "digest binary, row long, place long, times long")
    single = store(single, "single")
    twice = store(single.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"), "twice")
    discard(asked, mixed)
    return again.unionAll(ranked).unionAll(single.where("times = 1").join(twice, "digest").select("row", "place")), [kinds, rows, single, twice]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for k in range(len(batch)):
                data = np.frombuffer(batch.column("text")[k].as_py().encode("utf-8", "replace"), dtype=np.uint8)
                start, windows, _ = _unpack(batch.column("places")[k].values.to_numpy())
                edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + windows - 1 + length, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])))
                digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _row_number() -> Column:
    """Number of a row, fixed once it is stored; a partition with too many rows for it fails the job."""
    order = F.monotonically_increasing_id()
    inside = order.bitwiseAND(F.lit((1 << 33) - 1))
    number = F.shiftleft(F.shiftright(order, 33), _PLACE_BITS).bitwiseOR(inside)
    return F.when(inside < 1 << _PLACE_BITS, number).otherwise(F.raise_error(F.lit("more rows in a partition than row numbers allow for")).cast("long"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document without its repeated strings.

    The scan is stored with the texts and row numbers; texts travel twice, and only where something may go.
    """
    if not (0 < gram <= length <= gram + 200):
        raise ValueError("gram must be at most length, and length at most gram + 200")
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", text_of().alias("text")).select(_row_number().alias("row"), "doc_id", "text")
    scan = store(slim.mapInArrow(_scan(length, gram), f"row long, doc_id {kind}, text string, n_bytes long, sha256 string, place array<long>, bucket array<long>"), "scan")
    runs = scan.select("row", F.explode(F.arrays_zip("place", "bucket")).alias("r")).select("row", "r.place", "r.bucket")
    again = store(runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "again")
    shared = store(runs.join(again, "bucket").groupBy("row").agg(F.collect_list(F.struct("place", "bucket")).alias("asked")), "shared")
    schema = "row long, place long, bucket long, digest binary, head binary, tail binary"
    found = store(scan.select("row", "text").join(shared, "row").mapInArrow(_contexts(length), schema), "found")
    discard(again, shared)
    gone, used = _settled(found, length, cell_width(length, gram), crowd)
    places = store(gone.groupBy("row").agg(F.collect_list("place").alias("places")), "gone")
    discard(found, *used)
    touched = scan.select("row", "doc_id", "text", "n_bytes").join(places, "row").mapInArrow(_cut(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = scan.select("row", "doc_id", "n_bytes", "sha256").join(places.select("row"), "row", "left_anti")
    untouched = whole.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return touched.unionAll(untouched)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
