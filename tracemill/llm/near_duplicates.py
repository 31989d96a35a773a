"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

Each document becomes the set of its distinct word shingles. Equal sets are one node. A node has
``BANDS * ROWS`` MinHash values: their bands give buckets, and folded into a parity bitmap (an odd
sketch) they give a precise estimate of high similarities from the population count of an exclusive or.
Candidates are nodes that share a bucket; sizes and odd sketches sift them, and the exact similarity of
the full sets decides every link.

Buckets may hold a third of all nodes, so pairs within one are never all made. First each bucket's nodes
are compared with one pivot only, the node that shares most buckets with others, as the text that a group
was copied from does, and links join nodes into components. Nodes of buckets that still hold several
components then meet on their rare shingles: sets with a similarity of t or more share one of the
n - ceil(t * n) + 1 shingles that come first in any order common to all, here the rarest first, so no
link between components is lost, and texts that differ in their own words don't meet. With similarity
0.8 a link misses all 40 bands of five with probability 1.2e-7; the sketch sift sits five standard
deviations below the threshold.

Defined cases: null and empty texts have the empty set and are linked with nothing; repeated rows and
equal sets are linked; of a component the least id stays, and all rows that repeat it; rows without an id get
no component and are kept; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, store, text_of
from .components import connected_components

SIZE, PERCENT = 2, 80
BANDS, ROWS, SKETCH_BITS = 40, 5, 1024
SIFT = 0.65
_SEED = 20240501
_CHUNK, _KNOWN = 50_000, 50_000  # shingles hashed at a time, words whose hashes a worker keeps


class _WordHashes(dict):
    """Hashes of words seen by this worker; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, size: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; bytes.split and bytes.lower are ASCII only, as asked for."""
    words = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(size, len(h))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        x = mix(x) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(x))


def _minima(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each set; no set is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * m, starts) for m in multipliers], axis=1)


def odd_sketches(minima: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps, as rows of signed 64-bit words: each sample flips one bit."""
    n, k = minima.shape
    place = (mix(minima ^ (np.arange(k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(bits)).astype(np.int64)
    parity = np.bincount((np.arange(n)[:, None] * bits + place).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view("<i8")


def _signer(size: int, bands: int, rows: int):
    multipliers = np.random.default_rng(_SEED).integers(1 << 32, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                sets, total, end = [], 0, begin
                while end < len(texts) and total < _CHUNK:
                    sets.append(shingle_set(texts[end], size, cache))
                    total, end = total + len(sets[-1]), end + 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), *signed(sets)], names=["doc_id", *_SIGNED])
                begin = end

    def signed(sets: list[np.ndarray]) -> list[pa.Array]:
        full = [k for k, s in enumerate(sets) if len(s)]
        band = np.zeros((len(sets), bands), dtype=np.int64)
        sketch = np.zeros((len(sets), SKETCH_BITS // 64), dtype=np.int64)
        if full:
            minima = _minima([sets[k] for k in full], multipliers)
            key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::rows])
            band[full], sketch[full] = key.view(np.int64), odd_sketches(minima)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)

        def lists(values: np.ndarray, width: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(values.ravel()))

        return [pa.array(sizes), _nodes(sets), lists(band, bands), lists(sketch, SKETCH_BITS // 64)]

    return run


_SIGNED = ("n_shingles", "node", "bands", "sketch")


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    """128-bit names of sets; none for the empty one."""
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _set_reader(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                sets = [shingle_set(t, size, cache) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("wanted"), _nodes(sets), held], names=["wanted", "node", "shingles"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (doc_id, node), from the texts of documents that stand for them."""
    bound_batches(docs.sparkSession)
    slim = docs.select("doc_id", text_of().alias("text")).join(wanted.select("doc_id", F.col("node").alias("wanted")), "doc_id")
    read = slim.select("wanted", "text").mapInArrow(_set_reader(size), "wanted binary, node binary, shingles array<long>")
    return read.where("node = wanted").select("node", "shingles").dropDuplicates(["node"])


def signatures(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    bound_batches(docs.sparkSession)
    slim = docs.select("doc_id", text_of().alias("text"))
    return slim.mapInArrow(_signer(size, bands, rows), f"doc_id {dict(slim.dtypes)['doc_id']}, n_shingles long, node binary, bands array<long>, sketch array<long>")


def estimated_similarity(a: Column, b: Column, samples: int, bits: int = SKETCH_BITS) -> Column:
    """Jaccard similarity by two odd sketches; null where they differ too much to tell."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return F.when(2 * apart < bits, 1 + F.log(1 - 2 * apart / bits) * (bits / (4 * samples)))


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, samples: int) -> DataFrame:
    """Those of the pairs (a, b) that are links: sifted by odd sketch, then decided on the full sets."""
    margin = SIFT * percent / PERCENT
    known = nodes.select("node", "sketch")
    likely = (
        pairs.join(known.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(known.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .where(estimated_similarity(F.col("sketch_a"), F.col("sketch_b"), samples) >= margin)
        .select("a", "b")
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return store(both.where(100 * shared >= percent * union).select("a", "b"), "links")


def link(docs: DataFrame, signed: DataFrame, size: int = SIZE, percent: int = PERCENT, samples: int = BANDS * ROWS) -> DataFrame:
    """(node, root): components over all nodes that have links. ``signed``: stored :func:`signatures` of ``docs``.

    What two sides of a join have aggregated is stored first, so that Spark can split the join at a hot key.
    """
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = store(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = store(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    full = store(entries.join(shared, "bucket"), "full")
    central = store(full.groupBy("node").agg(F.sum("members").alias("met")), "central")
    crowded = store(full.join(central, "node").select("bucket", "node", "n", "met"), "buckets")
    candidates = store(nodes.select("node", "doc_id", "sketch").join(crowded.select("node").distinct(), "node", "left_semi"), "candidates")
    sets = store(full_sets(docs, candidates, size), "sets")
    central = F.min(F.struct((-F.col("met")).alias("draw"), "node", "n")).alias("p")
    pivots = store(crowded.groupBy("bucket").agg(central).select("bucket", F.col("p.node").alias("other"), F.col("p.n").alias("other_n")), "pivots")
    met = crowded.join(pivots, "bucket").where("node <> other").where(_sizes_fit(percent))
    pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = _confirmed(pairs, candidates, sets, percent, samples)
    roots = connected_components(links)

    placed = store(crowded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "placed")
    still = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    unmet = store(placed.join(store(still, "open"), "bucket").select("node", "root").distinct(), "unmet")
    heads = store(rare_shingles(sets.join(unmet, "node"), percent), "heads")
    others = heads.select("shingle", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root"), F.col("place").alias("other_place"))
    # Nothing before the first shared shingle is shared, so both rests must be long enough for the overlap that a link needs.
    can_reach = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) >= percent * (F.col("n") + F.col("other_n"))
    pairs = heads.join(others, "shingle").where("root < other_root").where(_sizes_fit(percent) & can_reach).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return connected_components(links.unionAll(_confirmed(pairs, candidates, sets, percent, samples)))


def _sizes_fit(percent: int) -> Column:
    return F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, n, place, shingle): of each set of (node, root, shingles) the rarest with their place from 0, of which it shares one with every set it can be linked with."""
    entries = store(sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "entries")
    counted = store(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "holders")
    held = entries.join(counted, "shingle", "left").select("node", "root", "n", F.struct(F.coalesce("holders", F.lit(1)).alias("holders"), "shingle").alias("entry"))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    first = held.groupBy("node", "root", "n").agg(F.array_sort(F.collect_list("entry")).alias("entries")).select("node", "root", "n", F.posexplode(F.slice("entries", F.lit(1), head)).alias("place", "entry"))
    return first.where("entry.holders > 1").select("node", "root", "n", "place", F.col("entry.shingle").alias("shingle"))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: component_id is the least id it can reach by links."""
    signed = store(signatures(docs, size, bands, rows), "signatures")
    roots = link(docs, signed, size, percent, bands * rows)
    own = signed.select("doc_id", "n_shingles", "node")
    filled = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = filled.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = store(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    # Stored, so that Spark can split the join at a component that has very many nodes.
    top = store(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "top")
    by_node = store(rooted.join(top, "root").select("node", "component_id"), "components")
    linked = filled.join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    alone = own.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
