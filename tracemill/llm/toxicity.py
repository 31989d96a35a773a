"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are the 3-, 4- and 5-grams of code points that a text holds (A-Z lower-cased), hashed to
``HASH_BITS`` bits; all of them are used. Each is scaled by its naive Bayes log-count ratio between the
labelled classes, with ``SMOOTHING`` pseudo-texts dealt to the classes by their share, so that rare
n-grams say little; a text's values are divided by the root of their number. A logistic regression is
trained over the scaled features. Only its training is bounded: at most ``max_rows`` labelled rows, chosen
by hash of the id. Class counts come from the executors as one row per hashed n-gram, and the rows' lists
of n-grams go to the driver, some 4 bytes for each. Scoring is one pass over all texts.

Defined cases: null text reads as empty and gets the score of a text without features; rows with a null
id are scored but never trained on; null labels are not used; repeated rows and ids count as often as they
stand and score alike; labelled ids at equal hashes are taken by id, then label; without any labelled row
of both classes the score is 0.5 throughout; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, doc_crc, documents, text_of

SIZES, HASH_BITS = (3, 4, 5), 20
MAX_ROWS, SMOOTHING, THRESHOLD = 4000, 5.0, 0.7
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _last_place() -> np.ndarray:
    return np.zeros(1 << HASH_BITS, np.int32)


def distinct_grams(text: str) -> np.ndarray:
    """The hashed n-grams of a text, each once."""
    flat = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    flat[(flat >= 65) & (flat <= 90)] += np.uint64(32)
    value, codes = flat, [np.zeros(0, np.int32)]
    for k in range(1, min(max(SIZES), len(flat))):
        value = value[:-1] * _BASE + flat[k:]
        if k + 1 in SIZES:
            codes.append((((value + np.uint64(k)) * _MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    found, last = np.concatenate(codes), _last_place()
    place = np.arange(len(found), dtype=np.int32)
    last[found] = place  # what an earlier text left there is never looked at
    return found[last[found] == place]


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # of every hashed n-gram, with its naive Bayes ratio in it
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            grams = distinct_grams(text)
            z[k] += self.weights[grams].sum(dtype=np.float64) / np.sqrt(max(len(grams), 1))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_class = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            by_class[label, distinct_grams(text)] += 1
    grams = np.flatnonzero(by_class.sum(axis=0))
    for k in range(0, len(grams), 50_000):
        g = grams[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(by_class[0, g], pa.int64()), pa.array(by_class[1, g], pa.int64())], names=["gram", "clean", "toxic"])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 200):
            part = batch.slice(a, 200)
            grams = [distinct_grams(t) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, grams)])
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))], names=["label", "grams"])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Text and label of at most ``max_rows`` documents outside the held-out fold, chosen by hash of the id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % 3 != 1))
    chosen = usable.select("doc_id", F.col("toxic").cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # At most max_rows ids with their labels, so this side is small whatever the corpus.
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, smoothing: float = SMOOTHING, epochs: int = 20) -> ToxicityModel:
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, max_rows)
    counted = sample.mapInArrow(_count, "gram int, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    rows = sample.mapInArrow(_list, "label long, grams array<int>").toArrow()
    label = rows.column("label").to_numpy()
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n0 or not n1:
        return ToxicityModel(np.zeros(1 << HASH_BITS, np.float32), 0.0)
    gram, toxic, clean = (counted.column(c).to_numpy() for c in ("gram", "toxic", "clean"))
    ratio = np.zeros(1 << HASH_BITS, np.float32)
    share = n1 / (n0 + n1)
    ratio[gram] = np.log((toxic + smoothing * share) / n1) - np.log((clean + smoothing * (1 - share)) / n0)
    lists = rows.column("grams").combine_chunks()
    return _fit(ratio, label.astype(np.float64), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), epochs)


def _fit(ratio: np.ndarray, label: np.ndarray, size: np.ndarray, gram: np.ndarray, epochs: int, batch: int = 512, rate: float = 0.03, ridge: float = 1e-5) -> ToxicityModel:
    """Logistic regression over the scaled features by Adam, classes weighted alike."""
    begin = np.concatenate([[0], np.cumsum(size)])
    seen = np.flatnonzero(np.bincount(gram, minlength=len(ratio)))  # the others keep their weight
    index = np.zeros(len(ratio), np.int32)
    index[seen] = np.arange(len(seen), dtype=np.int32)
    gram, whole, ratio = index[gram], ratio, ratio[seen]
    w, m, v, bias, step = (np.ones(len(ratio)), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), 0.0, 0)
    balance = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label).mean())
    order = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = order.permutation(len(label))
        for k in range(0, len(label), batch):
            chosen = shuffled[k : k + batch]
            place = np.concatenate([gram[begin[i] : begin[i + 1]] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), size[chosen])
            value = ratio[place] / np.sqrt(size[chosen])[row]
            z = bias + np.bincount(row, weights=value * w[place], minlength=len(chosen))
            gap = balance[chosen] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[chosen]) / len(chosen)
            slope = np.append(np.bincount(place, weights=value * gap[row], minlength=len(w)) + ridge * w, gap.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
    weights = whole.astype(np.float32)
    weights[seen] = w * ratio
    return ToxicityModel(weights, float(bias))


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):  # so that few texts are decoded at a time
                part = batch.slice(a, 1000)
                texts = part.column("text") if "text" in part.schema.names else part.column("kept").field("text")
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(model.score([t or "" for t in texts.to_pylist()]))], names=["kept", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, in a struct ``kept``, with ``score``."""
    bound_batches(docs.sparkSession)
    kept = F.struct(*[docs[c] for c in keep]).alias("kept")
    slim = docs.select(kept) if "text" in keep else docs.select(kept, text_of().alias("text"))  # no text travels twice
    return slim.mapInArrow(_scorer(model), f"kept {slim.schema['kept'].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(doc_crc(F.col("kept.doc_id")) % 3 == 1, F.lit(False))
    return score(docs, model, ["doc_id"]).select("kept.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
