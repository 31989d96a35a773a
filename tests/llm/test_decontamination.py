"""Decontamination against every window of every document, with edited passages."""

import collections
import random

import pytest

from tracemill.llm import decontamination


def shingles(words):
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]
    return collections.Counter(runs)


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(500)]
    items = {k: rnd.choices(words, k=n) for k, n in enumerate((15, 20, 33, 60, 90, 120, 4, 2))}
    docs = {}
    for d in range(260):
        text = rnd.choices(words, k=rnd.randint(0, 200))
        if d % 4:
            passage = list(items[rnd.randrange(len(items))])
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(passage))
                passage[at : at + 1] = rnd.choice(([], ["new"], [passage[at], "more"]))
            at = rnd.randint(0, len(text))
            text[at:at] = passage * rnd.choice((1, 1, 2))
        docs[d] = text
    return docs, items


def expected(docs, items):
    found = {}
    for d, text in docs.items():
        for k, item in items.items():
            wanted = shingles(item)
            for start in range(max(1, len(text) - len(item) + 1)):
                window = text[start : start + len(item)]
                if window and (s := similarity(shingles(window), wanted)) >= 0.8 and s > found.get((d, k), (0,))[0]:
                    found[d, k] = (s, start)
    return found


@pytest.mark.parametrize("max_rows", [decontamination.MAX_BROADCAST_ROWS, 0])
def test_every_pair(spark, tables, max_rows):
    docs, items = tables
    frame = spark.createDataFrame([(d, " ".join(w).upper(), "clash") for d, w in docs.items()], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(k, " ".join(w), "clash") for k, w in items.items()], "item_id long, text string, fingerprint string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontamination.contaminated(frame, bench, max_broadcast_rows=max_rows).collect()}
    wanted = {k: (round(s, 9), at) for k, (s, at) in expected(docs, items).items()}
    assert len(wanted) > 60 and found.keys() == wanted.keys()  # recall 1 here, long and short items, none besides
    # The reported window is the best of those aligned on a shingle that was looked up.
    assert all(0.8 <= found[k][0] <= wanted[k][0] for k in found) and sum(found[k][0] == wanted[k][0] for k in found) > 0.8 * len(found)


@pytest.mark.parametrize("max_rows", [decontamination.MAX_BROADCAST_ROWS, 0])
def test_every_window(spark, tables, max_rows):
    """The best window and the number of all similar ones, among windows from every word on, also where items are alike and a text repeats one."""
    docs, items = tables
    docs = docs | {900: items[2] * 3, 901: items[3][:-5], 902: items[4][3:] + ["x"] * 70, 903: items[1][:16] + ["y"], 904: ["p"] * 100, 905: items[0][:10] + ["z"] + items[0][11:]}
    items = items | {20: items[2][:-1] + ["other"], 21: ["p"] * 30, 22: ["p"] * 3}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_windows) for r in decontamination.contaminated(frame, bench, max_broadcast_rows=max_rows).collect()}
    wanted = collections.Counter()
    for d, text in docs.items():
        for k, item in items.items():
            for start in range(max(1, len(text) - len(item) + 1)):
                window = text[start : start + len(item)]
                wanted[d, k] += bool(window) and similarity(shingles(window), shingles(item)) >= 0.8
    best = expected(docs, items)
    assert found == {k: (round(best[k][0], 9), best[k][1], n) for k, n in wanted.items() if n}


def test_nulls_repeats_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x a b c d e f g"), (3, "A B C D E F G y"), (3, "A B C D E F G y"), (4, None), (5, "")], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.item_id, r.similarity, r.start) for r in decontamination.contaminated(docs, bench).collect())
    assert found == [(-1, 1, 1.0, 1), (-1, 2, 1.0, 1), (3, 1, 1.0, 0), (3, 2, 1.0, 0)]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == decontamination.contaminated(docs.limit(0), bench).count() == 0
