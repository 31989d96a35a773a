"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Every window of as many words as an item has, from every word on, that can reach the similarity gets a
64-bit SimHash of its weighted shingles (weight: how often the window holds the shingle). Fingerprints are
matched against those of all items of that window size by multi-index Hamming blocks: with ``radius + 1``
blocks, two fingerprints within the radius agree in one block at least, so none is missed. What matches is
verified by exact weighted Jaccard similarity over five-word shingles.

Which windows can: a window of m shingles with similarity s has at most (1 - s) / (1 + s) * m shingles
foreign to the item. So documents are looked up at every ``stride``-th shingle, set from the shortest item
such that one shared shingle of each such window is always looked up. A place found leads to the two stretches
of m starts (at multiples of m) that the windows over it begin in; of their windows those with no more foreign
places than that are kept, all of them. Items of fewer than five words are looked up by every run of their own length.

At a similarity of 0.8 two windows' fingerprints differ in some 10 of 64 bits, so no block that must agree
by the pigeonhole can be wider than 64 / (radius + 1) bits: the bound leaves out windows, the blocks make
sure that no item within the radius is missed, and the exact similarity decides. A radius of 20 loses about
3 in 10,000 windows whose similarity is just 0.8.

Two shuffles move the stretches found and the pairs, not the documents: the item tables are
broadcast while they have at most ``MAX_BROADCAST_ROWS`` rows, and joined by shuffle beyond.

Defined cases: null or empty texts and items match nothing; an item or document of fewer than five
words has its whole word sequence as its one shingle; repeated items with the same text are all
reported; repeated rows give one result row per (doc_id, item_id); null ids are kept as null, as one;
of windows that are equally similar the first is reported; an empty table of either kind gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, store, text_of, words_of
from .shingles import SIMILARITY, SIZE, occurrences, shingle_hashes

RADIUS, MAX_BROADCAST_ROWS = 20, 200_000
_LANES = 16  # counters of 16 bits, four in a long
_LANE_ONES = 0x0001000100010001


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of at most 65,535 shingle hashes: each bit by majority.

    Sixteen longs count four bits each, so one fold over the array counts all 64.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(_LANES)])
    counts = F.aggregate(hashes, zero, lambda acc, h: F.struct(*[(acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANE_ONES))).alias(f"c{k}") for k in range(_LANES)]))
    return counts


def _fingerprint(counts: Column, n: Column) -> Column:
    bits = [F.shiftleft((F.shiftrightunsigned(counts[f"c{k}"], 16 * lane).bitwiseAND(F.lit(0xFFFF)) * 2 > n).cast("long"), 16 * lane + k) for k in range(_LANES) for lane in range(4)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def block_masks(radius: int = RADIUS) -> list[int]:
    """Masks of ``radius + 1`` blocks that part the 64 bits, as signed longs."""
    edges = [round(k * 64 / (radius + 1)) for k in range(radius + 2)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _fingerprinted(df: DataFrame) -> DataFrame:
    """Adds shingles (as a sorted multiset written as a set) and fingerprint to rows with ``hashes``, which stay, sorted."""
    keep = [c for c in df.columns if c != "hashes"]
    counted = df.select(*keep, F.sort_array("hashes").alias("hashes"), simhash(F.col("hashes")).alias("counts"))
    return counted.select(*keep, "hashes", occurrences(F.col("hashes")).alias("shingles"), _fingerprint(F.col("counts"), F.size("hashes")).alias("fingerprint"))


def _blocks(masks: list[int]) -> Column:
    """(block, value) of a row's fingerprint for each of the blocks."""
    return F.posexplode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fingerprint").bitwiseAND(m)))


def _runs(words: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.slice(words, i, size))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_windows) of every document that holds an item; start counts words from 0.

    Similarity and start are those of the best window, ``n_windows`` counts all that are similar.
    """
    item_words = items.select("item_id", words_of(text_of()).alias("words")).where(F.size("words") > 0)
    known = store(_fingerprinted(item_words.select("item_id", F.size("words").alias("n_words"), shingle_hashes(F.col("words")).alias("hashes"))), "items")
    shape = known.agg(F.min(F.when(F.col("n_words") >= SIZE, F.col("n_words"))).alias("least"), F.array_sort(F.collect_set(F.when(F.col("n_words") < SIZE, F.col("n_words")))).alias("short"), F.sum(F.size("shingles")).alias("shingles"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"]:
        return docs.join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("n_windows"))
    foreign = (1 - similarity) / (1 + similarity)
    stride = max(1, math.floor(1 / (foreign + 1 / max(1, (shape["least"] or SIZE) - SIZE + 1))))
    small = max(shape["shingles"], shape["n"] * (radius + 1)) <= max_broadcast_rows
    dealt = F.broadcast if small else (lambda side: side)

    # What windows are held against, once however many items are alike; m is the number of shingles.
    contents = known.select(F.xxhash64("n_words", "hashes").alias("content"), "n_words", (F.col("n_words") - (SIZE - 1)).alias("m"), F.array_distinct("hashes").alias("own")).where(F.col("n_words") >= SIZE).dropDuplicates(["content"])
    places = contents.select("content", "n_words", "m", F.explode("own").alias("shingle"))
    worded = docs.select("doc_id", words_of(text_of()).alias("words")).where(F.size("words") > 0)
    n, m, size = F.size("words"), F.col("m"), F.col("n_words")
    looked_up = F.transform(F.sequence(F.lit(1), n - (SIZE - 1), F.lit(stride)), lambda i: F.xxhash64(F.slice(F.col("words"), i, SIZE)))
    hits = worded.where(n >= SIZE).select("doc_id", "words", F.posexplode(looked_up).alias("k", "shingle")).join(dealt(places), "shingle")
    last = F.floor(F.col("k") * stride / m).cast("int")
    over = hits.select("doc_id", "words", "content", "n_words", "m", F.explode(F.array(last - 1, last)).alias("stretch"))
    begin = F.col("stretch") * m
    stretches = over.where((F.col("stretch") == 0) | (F.col("stretch") > 0) & (begin + size <= n)).select("doc_id", "content", begin.alias("begin"), F.slice("words", begin + 1, m + size - 1).alias("words")).distinct()

    hashed = stretches.select("doc_id", "content", "begin", n.alias("n"), shingle_hashes(F.col("words")).alias("hashes")).join(dealt(contents), "content")
    found_at = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains("own", F.get("hashes", i)))
    placed = hashed.select("doc_id", "n_words", "m", "begin", "n", "hashes", found_at.alias("at"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(m - 1, F.col("n") - size)))
    length = F.least(m, F.size("hashes"))
    least = similarity / (1 + similarity) * (m + length) - 1e-9  # of shared shingles
    kept = F.filter(starts, lambda s: F.size(F.filter("at", lambda i: (i >= s) & (i < s + length))) >= least)
    windows = placed.select("doc_id", "n_words", "begin", "hashes", length.alias("length"), F.explode(kept).alias("s"))
    windows = windows.select("doc_id", "n_words", (F.col("begin") + F.col("s")).alias("start"), F.slice("hashes", F.col("s") + 1, F.col("length")).alias("hashes"))
    for few in shape["short"]:  # at most SIZE - 1 lengths
        each = worded.where(n >= few).select("doc_id", F.posexplode(_runs(F.col("words"), few)).alias("start", "run")).select("doc_id", "start", F.array(F.xxhash64("run")).alias("hashes"))
        own = known.where(size == few).select("n_words", F.get("hashes", F.lit(0)).alias("shingle")).distinct()
        windows = windows.unionByName(each.join(dealt(own), F.get("hashes", F.lit(0)) == F.col("shingle")).select("doc_id", "n_words", "start", "hashes"))

    masks = block_masks(radius)
    seen = _fingerprinted(windows.withColumn("window", F.xxhash64("hashes"))).drop("hashes")
    left = seen.select("*", _blocks(masks).alias("block", "value"))
    right = known.select("item_id", "n_words", F.col("shingles").alias("item_shingles"), F.col("fingerprint").alias("item_fingerprint"), _blocks(masks).alias("block", "value"))
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    earlier = F.slice(F.array(*[F.lit(m).cast("long") for m in masks]), F.lit(1), F.col("block"))
    near = left.join(dealt(right), ["n_words", "block", "value"]).where((F.bit_count(apart) <= radius) & F.forall(earlier, lambda m: apart.bitwiseAND(m) != 0))
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    scored = near.select("doc_id", "item_id", "start", "window", (shared / (F.size("shingles") + F.size("item_shingles") - shared)).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best")
    # A window that several contents lead to, and one of a repeated row, counts once.
    found = scored.where(F.col("similarity") >= similarity).distinct().groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("n_windows"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).alias("start"), "n_windows")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
