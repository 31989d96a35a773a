"""Periodic runs in the word sequence of each document, and the text without their repetitions.

A run is a stretch with a smallest period that fits at least twice and that no neighbour extends. By the
runs theorem each run holds a longest Lyndon word of one of the two orders of the alphabet, of the run's
period, at one of its starts. With the inverse suffix array the longest Lyndon word at a place ends at the
next smaller value (one order) or the next larger one (the other); so a document of n words has at most 2n
candidates. Each is extended to the right by the least value of the LCP array between two suffixes, by a
sparse table, and to the left in the same way over the reversed words.

All of it is array arithmetic over many documents at once: each ends in a mark that is smaller than any
word and stands there only, and suffixes are ordered by document first, so that none is compared across.
Of one run only the first Lyndon root is extended to the left, and only where the word furthest away that
a run needs agrees; documents without such a candidate have no reversed arrays built.

Defined cases: null text reads as empty; texts without words have no runs and an empty collapsed text; rows
keep their id, null or repeated, and equal texts come out alike; empty tables give empty results; other
columns, whatever their names, are ignored. Memory: some 300 bytes a word of ``CHUNK`` bytes of text, or of
the one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, bound_batches, doc_crc, documents, in_chunks, text_of

MIN_LENGTH, CHUNK = 12, 1 << 20
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, end of each word among them, number of words of each text)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[(at[:-1] - at[0])[at[:-1] < at[-1]]] = False
    starts = np.flatnonzero(inside & ~before)
    kept_before = np.cumsum(inside)
    ends = np.append(kept_before[starts[1:]] - 1, kept_before[-1]) if len(starts) else np.empty(0, np.int64)
    return raw[inside], ends, np.diff(np.searchsorted(starts, at - at[0]))


def _symbols(content: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 1 for each different word."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1


def suffix_array(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverse suffix array, LCP array) of texts that each end in one symbol 0, ordered by ``owner`` first.

    Ranks of prefixes of 1, 2, 4 ... symbols are refined until all differ; only suffixes that still share
    their rank are sorted again. The LCP of neighbours is added up from the ranks, longest prefix first.
    """
    n = len(symbols)
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    slots, active, ordered = np.arange(n), order, key[order]
    rank, levels, span = np.empty(n, np.int64), [], 1
    while True:
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        rank[active] = slots[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        shared = ~first
        shared[:-1] |= ~first[1:]
        if not shared.any():
            break
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        slots, active = slots[shared], active[shared]
        key = (rank[active] << 32) + rank[active + span] if n < 1 << 31 else rank[active] * n + rank[active + span]
        by = np.argsort(key, kind="stable")
        active, ordered, span = active[by], key[by], 2 * span
        order[slots] = active
    lcp = np.zeros(n, np.int32)
    if levels:
        alike = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b, total = order[alike - 1], order[alike], np.zeros(len(alike), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            total += (levels[k][a + total] == levels[k][b + total]).astype(np.int64) << k
        lcp[alike] = total
    return rank, lcp


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range, ends included: a sparse table of which one level is held at a time."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    by = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by], np.arange(int(level.max(initial=-1)) + 2))
    table = values
    for k in range(len(bounds) - 1):
        asked = by[bounds[k] : bounds[k + 1]]
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def common_prefixes(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, which differ and have one owner."""
    low, high = np.minimum(rank[a], rank[b]), np.maximum(rank[a], rank[b])
    return range_minima(lcp, low + 1, high).astype(np.int64)


def next_smaller(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place, in order, the next one with a smaller value; there must be one.

    Blocks of 1, 2, 4 ... values are passed while their least is larger, then smaller blocks again.
    """
    tables, at, stopped = [values], places + 1, np.zeros(len(places), np.int64)
    active, k = np.arange(len(places)), 0
    while len(active):
        if k:
            tables.append(np.minimum(tables[-1][: -(1 << (k - 1))], tables[-1][1 << (k - 1) :]))
        fits = at[active] < len(tables[k])
        passed = fits.copy()
        passed[fits] = tables[k][at[active[fits]]] > values[places[active[fits]]]
        stopped[active[~passed]] = k
        active = active[passed]
        at[active] += 1 << k
        k += 1
    by = np.argsort(-stopped, kind="stable")
    counts = np.searchsorted(-stopped[by], -np.arange(k))  # how many stopped above each level
    for j in range(k - 2, -1, -1):
        some = by[: counts[j]]
        some = some[at[some] < len(tables[j])]
        some = some[tables[j][at[some]] > values[places[some]]]
        at[some] += 1 << j
    return at


def find_runs(symbols: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, ordered so; ``symbols`` are from 1, of all texts one after another."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(symbols)) + owner  # in the array with end marks
    last = np.cumsum(counts) + np.arange(len(counts))
    begin = last - counts
    marked = np.zeros(len(symbols) + len(counts), np.int64)
    marked[place] = symbols
    rank, lcp = suffix_array(marked, np.repeat(np.arange(len(counts)), counts + 1))
    falling = -rank
    falling[last] = -len(marked)
    roots, ends = [], []
    for values in (rank, falling):
        then = next_smaller(values, place)
        same = marked[place] == marked[then]
        roots.append(place[same]), ends.append(then[same])
    i, j = np.concatenate(roots), np.concatenate(ends)
    right = common_prefixes(rank, lcp, i, j)
    # Roots of one run share their period and where their extension ends; the first of them stays.
    by = np.lexsort((i, j - i, j + right))
    i, j, right = i[by], j[by], right[by]
    first = np.ones(len(i), bool)
    first[1:] = ((j - i)[1:] != (j - i)[:-1]) | ((j + right)[1:] != (j + right)[:-1])
    i, j, right = i[first], j[first], right[first]
    period, whose = j - i, np.searchsorted(last, i)
    needed = np.maximum(0, np.maximum(2 * period, min_length) - period - right)
    likely = i - begin[whose] >= needed
    likely[likely] = marked[(i - needed)[likely]] == marked[(j - needed)[likely]]
    i, j, right, period, whose = i[likely], j[likely], right[likely], period[likely], whose[likely]
    left = np.zeros(len(i), np.int64)
    if len(i):
        left = _common_suffixes(marked, begin, last, whose, i, j)
    long = left + period + right >= np.maximum(2 * period, min_length)
    i, period, whose, length = (i - left)[long], period[long], whose[long], (left + period + right)[long]
    start = i - begin[whose]
    by = np.lexsort((period, start, whose))
    return whose[by], start[by], length[by], period[by]


def _common_suffixes(marked: np.ndarray, begin: np.ndarray, last: np.ndarray, whose: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common suffix of what lies before i and before j, over the reversed texts that are asked for."""
    texts, which = np.unique(whose, return_inverse=True)
    size = last[texts] - begin[texts] + 1
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)
    within = np.arange(len(owner)) - base[owner]
    backwards = np.where(within == size[owner] - 1, 0, marked[last[texts][owner] - 1 - within])
    rank, lcp = suffix_array(backwards, owner)
    found, inner = np.zeros(len(i), np.int64), i > begin[whose]
    mirrored = (base[which] + last[whose])[inner]
    found[inner] = common_prefixes(rank, lcp, mirrored - i[inner], mirrored - j[inner])
    return found


def _joined(content: np.ndarray, ends: np.ndarray, kept: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    lengths = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(counts)), counts)[kept]
    gap = np.ones(len(owner), np.int64)
    if len(owner):
        gap[np.append(owner[1:] != owner[:-1], True)] = 0
    after = np.cumsum(lengths[kept] + gap)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[(after - 1)[gap == 1]] = False
    out[letters] = content[np.repeat(kept, lengths)]
    n_kept = np.bincount(owner, minlength=len(counts))
    offsets = np.concatenate(([0], np.concatenate(([0], after))[np.cumsum(n_kept)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(out))


def _collapsed(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK):
            content, ends, counts = split_words(batch.column("text"))
            text, start, length, period = find_runs(_symbols(content, ends), counts, min_length)
            base = (np.cumsum(counts) - counts)[text] + start
            deep = np.zeros(len(ends) + 1, np.int64)
            np.add.at(deep, base + period, 1), np.add.at(deep, base + length, -1)
            collapsed = _joined(content, ends, np.cumsum(deep[:-1]) == 0, counts)
            offsets = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed text) of every row.

    The collapsed text leaves out each word that lies in a run beyond the first period of it.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select("doc_id", text_of().alias("text"))
    return slim.mapInArrow(_collapsed(min_length), f"doc_id {dict(slim.dtypes)['doc_id']}, {_SCHEMA}")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, in which every tenth document by hash goes on repeating a stretch of itself from some word on."""
    h = doc_crc(doc_id)
    g, words = F.floor(h / 10), F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    stretch = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(stretch, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", repeated_tail(F.col("doc_id"), text_of()).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    written = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    start, period = -F.col("best.start"), -F.col("best.period")
    milli = F.floor(1000 * F.col("best.length") / period)
    return found.select("doc_id", "n_runs", start.alias("start"), F.col("best.length").alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
