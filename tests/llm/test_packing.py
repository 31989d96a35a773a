"""Vector best fit under tight capacities, and special tokens."""

import random

import numpy as np
import pytest

from tracemill.llm import packing


@pytest.mark.parametrize(("documents", "cost"), [(1024, None), (3, None), (1024, 20_000), (2, 30_000)])
def test_best_fit_holds_every_capacity_and_takes_the_tightest(documents, cost):
    rnd = random.Random(documents)
    lengths = np.array([rnd.choice((rnd.randint(1, 40), rnd.randint(1, 256))) for _ in range(300)])
    limit = cost or 256 * 256
    lengths = lengths[lengths**2 <= limit]
    sequence, offset = packing.best_fit(lengths, 256, documents, limit)
    # Brute force: every open sequence is tried for every piece, longest first.
    weights = [w / c for w, c in zip(packing.WEIGHTS, (256, documents, limit))]
    open_at, wanted = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = [s for s, (t, d, c) in enumerate(open_at) if t >= n and d >= 1 and c >= n * n]
        rest = lambda s: sum(w * left for w, left in zip(weights, (open_at[s][0] - n, open_at[s][1] - 1, open_at[s][2] - n * n)))  # noqa: B023, E731
        if fits:
            least = min(map(rest, fits))
            chosen = {s for s in fits if rest(s) <= least + 1e-12}
        else:
            open_at.append([256, documents, limit])
            chosen = {len(open_at) - 1}
        assert sequence[i] in chosen
        s = int(sequence[i])
        assert offset[i] == 256 - open_at[s][0]
        open_at[s] = [open_at[s][0] - n, open_at[s][1] - 1, open_at[s][2] - n * n]
        wanted[i] = s
    assert min(min(left) for left in open_at) >= 0


def test_special_tokens_are_those_of_the_plain_call():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|>", "no <|end|>", "x" * 50):
        assert packing.token_ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None), (3, None)], "doc_id long, text string")
    found = packing.pack_documents(docs.selectExpr("*", "1 AS number", "2 AS shard")).collect()
    assert len(found) == 4 and sorted(r.offset for r in found)[0] == 0 and sum(r.length for r in found) == 2 * len(packing.token_ids("one two")) + 4
