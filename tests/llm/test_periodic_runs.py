"""Periodic runs against a search over all periods, for word sequences of all kinds and for the query's contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracemill.llm import periodic_runs


def all_runs(words, least=12):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k + p - i >= max(least, 2 * p) and not any(all(words[x] == words[x + q] for x in range(i, k + p - q)) for q in range(1, p)):
                found.append((i, k + p - i, p))
            i = k + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept)


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
            texts.append((words[: rng.randint(1, 40)] * 10)[: rng.randint(1, 70)] if rng.random() < 0.4 else words)
        least = rng.choice([1, 2, 4, 12])
        found = periodic_runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least)
        runs = [[] for _ in texts]
        for text, *run in zip(*(column.tolist() for column in found)):
            runs[text].append(tuple(run))
        assert runs == [all_runs(t, least) for t in texts]


def test_long_sequences():
    fibonacci = [1]
    before = [1, 2]
    while len(before) < 30_000:
        fibonacci, before = before, before + fibonacci
    symbols = np.array(before + [7] * 50_000 + list(range(10, 40_010)) * 2)
    text, start, length, period = periodic_runs.find_runs(symbols, np.array([len(before), 50_000, 80_000]))
    assert (text == 0).sum() > 1000
    assert list(zip(start[text > 0].tolist(), length[text > 0].tolist(), period[text > 0].tolist())) == [(0, 50_000, 1), (0, 80_000, 40_000)]


def test_words_are_split_like_the_pattern():
    texts = ["a b", "", " \n", "x\x0bÜber  ", "nbsp in word", "end"]
    for array in (pa.array(["skip", *texts]).slice(1), pa.array(texts, pa.large_string())):
        content, ends, counts = periodic_runs.split_words(array)
        starts = [0, *ends[:-1].tolist()]
        words = [content[a:b].tobytes().decode() for a, b in zip(starts, ends.tolist())]
        expected = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
        assert words == [w for t in expected for w in t] and counts.tolist() == [len(t) for t in expected]


def test_contract(spark, folder, texts):
    found = {r.doc_id: tuple(r)[1:8] for r in periodic_runs.op12_periodic_runs(spark, folder).collect()}
    short = {i: t for i, t in texts.items() if len(t) < 5000}
    assert {i: found[i] for i in short} == {i: contract(i, t) for i, t in short.items()}
    assert sorted(found) == sorted(texts)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and found[i][0] for i in short)


def test_rows_of_all_kinds(spark):
    long = " ".join(f"w{i * i % 9973} v{i}" for i in range(60_000)) + " again and again" * 10
    rows = [(None, "a b c " * 5, 1), (1, None, 2), (1, "a b c " * 5, 3), (1, "a b c " * 5, 3), (2, " ", 4), (3, long, 5)]
    found = sorted(tuple(r) for r in periodic_runs.runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).where("doc_id IS NOT NULL").collect())
    assert [(r[0], r[1], len(r[2]), r[3][:9]) for r in found] == [(1, 0, 0, ""), (1, 15, 1, "a b c"), (1, 15, 1, "a b c"), (2, 0, 0, ""), (3, 120_030, 1, long[:9])]
    assert tuple(found[-1][2][0]) == (120_000, 30, 3)
    assert periodic_runs.runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
