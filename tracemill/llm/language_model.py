"""Language-model scores by a weighted backoff automaton.

The model is a word trigram model smoothed by interpolation with the bigram and unigram distributions. As
an automaton, each known word and each bigram seen ``LEAST_STATE`` times or more is a state. An n-gram is
an arc with its smoothed probability; a state's failure arc leads from a bigram to its last word and from
a word to the empty-context state, where every word has an arc, with the weight that the smoothing leaves
for it. One left-to-right traversal of a text carries the state and adds up the logarithms. Failure
weights depend on the state's length and on how often it is seen (by powers of two) and maximise the
leave-one-out likelihood of the training tokens, so every state's probabilities sum to one. Those of
bigram states are fitted against an even mixture of the two shorter distributions.

Counts grow with the corpus and are never gathered or broadcast. Documents are read once into blocks of
``BLOCK_CHARS`` characters: local token numbers and the hashes of the block's words. A block asks for the
totals of its own distinct n-grams: sorted hashes, cut by hash range and delta-coded, with its training
counts. Each range adds up what all blocks sent and answers each block in the order it asked. Trigrams
are asked for in a second round, and only after states that exist. So a frequent n-gram is one entry per
block however often it occurs, and a task holds one range or one block. The traversal of a block sees
exactly the part of the automaton that its texts can reach.

Defined cases: null text reads as empty and is the end token alone; rows without an id are trained on,
not held out; repeated rows count each, and equal texts score alike; without training rows all counts are
0 and every token has probability 1; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, documents, store, text_of
from .near_duplicates import mix

BLOCK_CHARS, RANGE_KEYS, LEAST_STATE = 4_000_000, 2_000_000, 2
#: Hash of the token that ends a text; as a context it stands for the beginning of one.
END = np.uint64(0x5851F42D4C957F2D)
_BINS, _BIN_WIDTH, _LEVELS = 80, 0.1, 48


def _squeeze(values: np.ndarray) -> bytes:
    """Small integers, compressed in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top <= np.iinfo(k).max)
    return kind.encode() + zstandard.compress(values.astype(kind).tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[2:]), dtype=data[:2].decode()).astype(np.int64)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte planes apart, with the all-zero top planes left out."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = max([k + 1 for k in range(8) if planes[k].any()], default=1)
    return bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes()


def _spread_keys(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :used] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel())


class _Block:
    """Tokens of the texts of one block and its distinct n-grams, in ascending order of their hashes."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.tokens, self.lengths = tokens, lengths
        self.train = np.repeat(train, lengths)
        self.before = np.roll(tokens, 1)  # the token before the first one of a text is the end of another
        if len(tokens):
            self.before[0] = 0
        order = np.argsort(words)
        self.uni_keys = words[order]
        self.uni_of = np.empty(len(words), np.int64)
        self.uni_of[order] = np.arange(len(words))
        mixed = mix(words) * np.uint64(3)
        self.bi_keys, place = np.unique(mix(mixed[self.before] + words[tokens]), return_inverse=True)
        self.bi_at = place.ravel()
        self.uni_at = self.uni_of[tokens] if len(tokens) else np.zeros(0, np.int64)

        self.first = np.zeros(len(tokens), bool)  # tokens that begin a text
        self.first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = len(tokens) > 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the block's own unigrams and bigrams."""
        return np.bincount(self.uni_at[self.train], minlength=len(self.uni_keys)), np.bincount(self.bi_at[self.train], minlength=len(self.bi_keys))

    def trigrams(self, bigram_totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens read in a bigram state, distinct hashes of the trigrams that they end, which of these each is)."""
        state = np.roll(self.bi_at, 1)  # the bigram before each token, where its text has one
        reached = np.flatnonzero(~self.first & (bigram_totals[state] >= LEAST_STATE)) if len(state) else state
        mixed = mix(self.bi_keys) * np.uint64(5)
        keys, place = np.unique(mix(mixed[state[reached]] + self.uni_keys[self.uni_at[reached]]), return_inverse=True)
        return reached, keys, place.ravel()


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    hashes, lengths, ids, train, parts = [int(END)], [], [], [], []

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        block = _Block(np.array(hashes, dtype=np.uint64), tokens.astype(np.int64), np.array(lengths), np.array(train, dtype=bool))
        columns = [pa.concat_arrays(ids), pa.array(train, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))]
        row = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        packed = zstandard.compress(tokens.tobytes(), 3)
        keys = len(block.uni_keys) + len(block.bi_keys)
        return pa.RecordBatch.from_arrays([*row, pa.array([packed], pa.binary()), pa.array([keys], pa.int64())], names=["ids", "train", "lengths", "words", "tokens", "n_keys"])

    chars = 0
    for batch in batches:
        for k, (text, is_train) in enumerate(zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True)):
            words = text.encode("utf-8", "replace").lower().split()
            for w in words:
                if w not in known:
                    known[w] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(w))
            parts.append(np.fromiter((*map(known.__getitem__, words), 0), dtype=np.uint32, count=len(words) + 1))
            lengths.append(len(words) + 1), train.append(is_train), ids.append(batch.column("doc_id").slice(k, 1))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield flush()
                known, hashes, lengths, ids, train, parts, chars = {}, [int(END)], [], [], [], [], 0
    if lengths:
        yield flush()


def _unpacked(batch: pa.RecordBatch, k: int) -> _Block:
    tokens = np.frombuffer(zstandard.decompress(batch.column("tokens")[k].as_py()), dtype=np.uint32).astype(np.int64)
    words, lengths, train = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("words", "lengths", "train"))
    return _Block(words.view(np.uint64), tokens, lengths, train.astype(bool))


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in ascending keys."""
    edges = np.array([(1 << 64) * j // ranges for j in range(ranges)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASKED = "span int, gram int, block long, keys binary, counts binary"
_ASKED_TYPES = {"span": pa.int32(), "gram": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}


def _asked(block: int, gram: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A block's keys of one length with its training counts, cut by hash range."""
    edge, out = _bounds(keys, ranges), {name: [] for name in _ASKED_TYPES}
    for j in np.flatnonzero(np.diff(edge)).tolist():
        mine = slice(edge[j], edge[j + 1])
        for name, value in zip(out, (j, gram, block, _squeeze_keys(keys[mine]), _squeeze(counts[mine])), strict=True):
            out[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in _ASKED_TYPES.items()], names=list(out))


def _ask_short(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = _unpacked(batch, k)
                for gram, keys, counts in zip((1, 2), (block.uni_keys, block.bi_keys), block.counts(), strict=True):
                    yield _asked(batch.column("block")[k].as_py(), gram, keys, counts, ranges)

    return run


def _totals(batch: pa.RecordBatch, k: int, column: str) -> dict[int, np.ndarray]:
    """Answered totals by length of the n-grams, in the order of the block's keys."""
    got: dict[int, list] = defaultdict(list)
    for part in sorted(batch.column(column)[k].as_py() or (), key=lambda a: (a["gram"], a["span"])):
        got[part["gram"]].append(_spread(part["totals"]))
    return defaultdict(lambda: np.zeros(0, np.int64), {gram: np.concatenate(parts) for gram, parts in got.items()})


def _ask_long(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = _unpacked(batch, k)
                reached, keys, which = block.trigrams(_totals(batch, k, "answers")[2])
                counts = np.bincount(which[block.train[reached]], minlength=len(keys))
                yield _asked(batch.column("block")[k].as_py(), 3, keys, counts, ranges)

    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of one hash range, for each block in the order in which it asked; types and tokens once."""
    asked = [_spread_keys(k) for k in frame["keys"]]
    keys = np.unique(np.concatenate(asked))
    counts = np.zeros(len(keys), np.int64)
    for own, sent in zip(asked, frame["counts"], strict=True):
        counts[np.searchsorted(keys, own)] += _spread(sent)
    totals = [_squeeze(counts[np.searchsorted(keys, own)]) for own in asked]
    first = np.arange(len(frame)) == 0
    return pd.DataFrame({"span": frame["span"], "gram": frame["gram"], "block": frame["block"], "totals": totals, "types": np.where(first, np.count_nonzero(counts), 0), "tokens": np.where(first, counts.sum(), 0)})


class _Automaton:
    """The part of the automaton that one block can reach.

    States are numbered: 0 is the empty context, then come the block's words and its bigrams. ``total`` says
    how often each is seen, ``failure`` where its failure arc leads. ``entered`` is the state in which each
    token is read and ``arcs`` how often the token follows the last one and two words.
    """

    def __init__(self, batch: pa.RecordBatch, k: int, n_tokens: int, n_types: int):
        b = self.block = _unpacked(batch, k)
        short, long = _totals(batch, k, "answers"), _totals(batch, k, "long_answers")
        n_uni, n_bi, n = len(b.uni_keys), len(b.bi_keys), len(b.tokens)
        self.total = np.concatenate([[0], short[1], short[2]])
        self.failure = np.zeros(1 + n_uni + n_bi, np.int64)
        self.failure[1 + n_uni + b.bi_at] = 1 + b.uni_at
        reached, _, which = b.trigrams(short[2])
        self.entered = 1 + b.uni_of[b.before] if n else np.zeros(0, np.int64)
        self.entered[reached] = 1 + n_uni + np.roll(b.bi_at, 1)[reached]
        self.long = self.entered > n_uni
        self.arcs = np.zeros((2, n), np.int64)
        self.arcs[0] = short[2][b.bi_at]
        self.arcs[1, reached] = long[3][which]
        self.seen = short[1][b.uni_at]
        self.root = (self.seen + 1) / (n_tokens + n_types + 1)

    def _chain(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, how often the state is seen, how often the arc is) for states of one word, then of two."""
        every, held = np.arange(len(self.entered)), np.flatnonzero(self.long)
        one = np.where(self.long, self.failure[self.entered], self.entered)
        return [(every, self.total[one], self.arcs[0]), (held, self.total[self.entered[held]], self.arcs[1, held])]

    def held(self) -> np.ndarray:
        """Training tokens by length and level of their states and by how much likelier the arc makes them when they themselves aren't counted."""
        cells, lower = [], self.root.copy()
        for order, (at, seen, arc) in enumerate(self._chain()):
            own = self.block.train[at]
            left = np.maximum(arc - 1, 0) / np.maximum(seen - 1, 1)
            gain = np.log10(np.maximum(left, 1e-12) / lower[at])
            bin_ = np.where(left > 0, np.clip(np.round(gain / _BIN_WIDTH) + _BINS // 4, 1, _BINS - 1), 0).astype(np.int64)
            cells.append(((order * _LEVELS + _level(seen)) * _BINS + bin_)[own])
            lower[at] = (left + lower[at]) / 2
        return np.bincount(np.concatenate(cells), minlength=2 * _LEVELS * _BINS)

    def traverse(self, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known, base, score) of each text: down the failure arcs the probability of each token builds up, and the logarithms add up."""
        p = self.root.copy()
        for order, (at, seen, arc) in enumerate(self._chain()):
            fail = np.where(seen > 0, weights[order, _level(seen)], 1.0)
            p[at] = (1 - fail) * arc / np.maximum(seen, 1) + fail * p[at]
        begin = np.concatenate([[0], np.cumsum(self.block.lengths)[:-1]])
        return self.block.lengths, *(np.add.reduceat(x, begin) for x in ((self.seen > 0).astype(np.int64), np.log10(self.root), np.log10(p)))


def _level(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), _LEVELS - 1)


def interpolation_weights(held: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weight of the failure arc by length and level of the state, maximising the likelihood of the binned leave-one-out ratios."""
    table = held.reshape(2, _LEVELS, _BINS).astype(float)
    ratio = 10.0 ** ((np.arange(_BINS) - _BINS // 4) * _BIN_WIDTH)
    ratio[0] = 0.0
    weights = np.full((2, _LEVELS), 0.5)
    for _ in range(rounds):
        share = weights[..., None] / (weights[..., None] + (1 - weights[..., None]) * ratio)
        weights = ((table * share).sum(axis=2) + 0.5) / (table.sum(axis=2) + 1)
    return np.clip(weights, 1e-4, 1 - 1e-4)


@dataclass(frozen=True)
class LanguageModel:
    """Blocks with the answers to all that they asked for, and what every traversal needs."""

    blocks: DataFrame
    weights: np.ndarray
    n_tokens: int
    n_types: int

    def score(self) -> DataFrame:
        """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document that was read."""
        kind = self.blocks.schema["ids"].dataType.elementType.simpleString()
        n_tokens, n_types, weights = self.n_tokens, self.n_types, self.weights

        def traversing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    n, known, base, score = _Automaton(batch, k, n_tokens, n_types).traverse(weights)
                    columns = [batch.column("ids")[k].values, pa.array(n), pa.array(known), pa.array(np.full(len(n), n_tokens, np.int64)), pa.array(base), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self.blocks.mapInArrow(traversing, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _answers(asked: DataFrame) -> DataFrame:
    return store(asked.groupBy("span", "gram").applyInPandas(_answer, "span int, gram int, block long, totals binary, types long, tokens long"), "answers")


def _with_answers(blocks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Blocks with all their answers. Not stored, so that the blocks lie on disk once, and once more while they are joined."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("gram", "span", "totals")).alias(column)), "block", "left")


def train_and_read(docs: DataFrame, train: str = "train") -> LanguageModel:
    """The model of the rows that the boolean column ``train`` marks, with all rows read for scoring."""
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    read = slim.mapInArrow(_read_blocks, f"ids array<{kind}>, train array<boolean>, lengths array<long>, words array<long>, tokens binary, n_keys long")
    blocks = store(read.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    ranges = max(1, -(-(blocks.agg(F.sum("n_keys")).first()[0] or 0) // RANGE_KEYS))
    answers = _answers(blocks.drop("ids", "n_keys").mapInArrow(_ask_short(ranges), _ASKED))
    size = answers.where("gram = 1").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    n_types, n_tokens = size["types"] or 0, size["tokens"] or 0
    short = _with_answers(blocks.drop("n_keys"), answers, "answers")
    full = _with_answers(short, _answers(short.drop("ids").mapInArrow(_ask_long(ranges), _ASKED)), "long_answers")

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * _LEVELS * _BINS, np.int64)
        for batch in batches:
            for k in range(len(batch)):
                total += _Automaton(batch, k, n_tokens, n_types).held()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], names=["cell", "n"])

    held = np.zeros(2 * _LEVELS * _BINS, np.int64)
    for row in store(full.mapInArrow(holding, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "held").collect():
        held[row["cell"]] = row["n"]  # at most 2 * _LEVELS * _BINS rows
    return LanguageModel(full, interpolation_weights(held), n_tokens, n_types)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(doc_crc(F.col("doc_id")) % 7 == 2, F.lit(False))
    scored = train_and_read(documents(spark, sf_dir).select("doc_id", "text", (~held_out).alias("train"))).score()
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
