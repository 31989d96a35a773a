"""Best-fit packing of tokenised documents into fixed-size training sequences.

Tokenising and cutting run where the documents are; only one small row per piece travels. Pieces are
dealt evenly into shards by their stored number, whatever their ids, and each shard is packed by vector best fit, decreasing: a sequence
has three residual capacities (tokens, documents, attention cost, the sum of squared lengths), and a
piece goes to the sequence that it fits in every dimension and leaves with the least weighted residual
norm. A shard holds about ``SHARD_PIECES`` pieces whatever the corpus, so memory is bounded, and the
open sequences at its end are the only cost of sharding.

Defined cases: null text reads as empty and is the end token alone; the tokenizer's own special tokens
in a text become their ids, as in its plain call; repeated rows, null ids among them, are packed each for
themselves; pieces of the same length are placed in the order of their numbers; an empty table gives no
pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, store, text_of

MAX_TOKENS, MAX_DOCUMENTS, END_ID = 1024, 1024, 2
#: Residual weights of tokens, documents and attention cost: tokens decide, the others break near-ties.
WEIGHTS = (1.0, 0.004, 0.004)
SHARD_PIECES = 20_000
TOKENIZER = "byte_bpe_50k"
#: Characters on which both tokenizer libraries split text alike; texts with others go to the slower one.
_PLAIN = re.compile(r"[\n\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ωА-я‘-”]*")


@lru_cache(maxsize=2)
def encoders(name: str = TOKENIZER):
    """(encoder of the ``tokenizers`` file, encoder of plain texts by the same vocabulary as ranks, pattern of the special tokens)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
    return slow, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(text: str, name: str = TOKENIZER) -> list[int]:
    """Ids that the plain call of the tokenizer gives, nothing added. Both ways give the same; the ranks are some three times as fast."""
    slow, fast, special = encoders(name)
    if (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text)) and not special.search(text):
        return fast.encode_ordinary(text)
    return slow.encode(text, add_special_tokens=False).ids


def _pieces(max_tokens: int, end_id: int, name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            source, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*token_ids(text, name), end_id], dtype="<u4")
                first = len(ids) % max_tokens or max_tokens
                for k, b in enumerate(range(first, len(ids) + 1, max_tokens)):
                    a = max(0, b - max_tokens)
                    source.append(row), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        ids_out.append(ids[a:b].tolist())
            columns = [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, number, place and crc of its ids, and the ids themselves if asked for.

    A longer document is cut from its end, so that only its first piece may be shorter than ``max_tokens``.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select("doc_id", text_of().alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return slim.mapInArrow(_pieces(max_tokens, end_id, name, with_ids), schema)


def best_fit(lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece under all three capacities, by decreasing length.

    Open sequences are kept by residual tokens, and within that by the weighted rest of their residual norm.
    The search goes up from the tightest residual and ends where its token part alone is worse than the best.
    """
    max_cost = max_cost or max_tokens * max_tokens
    w_tokens, w_docs, w_cost = weights[0] / max_tokens, weights[1] / max_documents, weights[2] / max_cost
    open_at: list[list[tuple[float, int, int, int]]] = [[] for _ in range(max_tokens + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        cost, best, where = n * n, float("inf"), None
        for r in range(n, max_tokens + 1):
            if w_tokens * (r - n) >= best:
                break
            for k, (rest, _, docs_left, cost_left) in enumerate(open_at[r]):
                norm = w_tokens * (r - n) + rest - w_docs - w_cost * cost
                if norm >= best:
                    break
                if docs_left >= 1 and cost_left >= cost:
                    best, where = norm, (r, k)
                    break
        if where:
            r, k = where
            _, s, docs_left, cost_left = open_at[r].pop(k)
        else:
            r, s, docs_left, cost_left = max_tokens, used, max_documents, max_cost
            used += 1
        sequence[i], offset[i] = s, max_tokens - r
        docs_left, cost_left = docs_left - 1, cost_left - cost
        if r > n and docs_left:
            bisect.insort(open_at[r - n], (w_docs * docs_left + w_cost * max(cost_left, 0), s, docs_left, cost_left))
    return sequence, offset


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_DOCUMENTS, max_cost: int | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to numbered :func:`pieces`; ``cut`` is read twice, so pass a stored table with a column ``number``.

    A shard is packed in the order of its numbers, so a task that runs again places every piece alike.
    """
    shards = max(1, -(-cut.count() // shard_pieces))
    names = [c for c in cut.columns if c not in ("ids", "number")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number", ignore_index=True)
        sequence, offset = best_fit(frame["length"].to_numpy(), max_tokens, max_documents, max_cost)
        return frame[names].assign(sequence_id=sequence + (int(frame["shard"].iloc[0]) << 40), offset=offset)

    dealt = cut.select(*names, "number", F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return dealt.groupBy("shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, **capacities) -> DataFrame:
    """Pieces of all documents with their sequences; see :func:`pieces` and :func:`pack`."""
    cut = pieces(docs, capacities.get("max_tokens", MAX_TOKENS))
    return pack(store(cut.withColumn("number", F.monotonically_increasing_id()), "pieces"), **capacities)


def sequences(docs: DataFrame, placed: DataFrame, max_tokens: int = MAX_TOKENS, name: str = TOKENIZER) -> DataFrame:
    """The training file: sequence_id and its token ids, joined from the pieces of ``docs`` by ``placed``.

    ``doc_id`` must be unique here, as the place of a piece is looked up by it.
    """
    ids: Column = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    cut = pieces(docs, max_tokens, name=name, with_ids=True).select("doc_id", "piece", "ids")
    return placed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"]).groupBy("sequence_id").agg(ids.alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
