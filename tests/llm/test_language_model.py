"""The automaton against its formula, and what it gains over the base."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import language_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    phrases = [rnd.choices(words, k=6) for _ in range(12)]
    texts = [" ".join(w for _ in range(rnd.randint(0, 12)) for w in (rnd.choice(phrases) if rnd.random() < 0.7 else rnd.choices(words, k=3))) for _ in range(150)]
    texts += [None, "", "W1 w1", "unknown here", texts[0], texts[0]]
    rows = [(i if i % 50 else None, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in enumerate(texts)]
    model = language_model.train_and_read(spark.createDataFrame(rows, "doc_id long, text string, train boolean").select("*", F.lit("clash").alias("tokens")).repartition(3))
    return rows, model, model.score().collect()


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def model_of(rows):
    counts = [collections.Counter() for _ in range(3)]
    for _, text, train in rows:
        if train:
            line = [None, *tokens(text)]
            counts[0].update(line[1:])
            counts[1].update(zip(line, line[1:]))
            counts[2].update(zip(line, line[1:], line[2:]))
    return counts


def probability(counts, weights, line, k):
    n, v = sum(counts[0].values()), len(counts[0])
    level = lambda c: min(int(math.log2(max(c, 1))), 47)
    p = (counts[0][line[k]] + 1) / (n + v + 1)
    if seen := counts[0][line[k - 1]]:
        fail = weights[0, level(seen)]
        p = (1 - fail) * counts[1][line[k - 1], line[k]] / seen + fail * p
    if k > 1 and (seen := counts[1][line[k - 2], line[k - 1]]) >= language_model.LEAST_STATE:
        fail = weights[1, level(seen)]
        p = (1 - fail) * counts[2][line[k - 2], line[k - 1], line[k]] / seen + fail * p
    return p


def test_scores_follow_the_formula(scored):
    rows, model, found = scored
    counts = model_of(rows)
    wanted = collections.Counter()
    for i, text, _ in rows:
        line = [None, *tokens(text)]
        wanted[i, len(line) - 1, round(sum(math.log10(probability(counts, model.weights, line, k)) for k in range(1, len(line))), 6)] += 1
    assert wanted == collections.Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in found)
    assert any(counts[1][p] >= 2 for p in counts[1])


def test_probabilities_of_a_state_sum_to_one(scored):
    rows, model, _ = scored
    counts = model_of(rows)
    for state in (("w1", "w2"), (None, "w3"), max(counts[1], key=lambda p: (p[1] is not None) * counts[1][p])):
        total = sum(probability(counts, model.weights, [*state, w], 2) for w in counts[0])
        unknown = probability(counts, model.weights, [*state, "never seen"], 2)
        assert math.isclose(total + unknown, 1, rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(scored):
    rows, _, found = scored
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 100
