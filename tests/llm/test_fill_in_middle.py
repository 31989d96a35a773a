"""Cuts and forms against the contract's pattern, and the exact round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracemill.llm import fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def contract(doc_id, text, rate=50, spm=80, marks=("<P>", "<S>", "<M>"), seed=42):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, s, m = marks
    spm_form = h4 % 100 < spm
    return n, "spm" if spm_form else "psm", len(prefix), len(middle), s + suffix + p + prefix + m + middle if spm_form else p + prefix + s + suffix + m + middle


TEXTS = ["", " ", " \t\n", "a", " a", "a ", " a b  c\x0b\x0c ", "Ü über\r\n𝄞 clef", "has <M> in it", "< P> <P <<S", "<<<", "x <S>", "line\n" * 2000, "  odd \x1c space"]


@pytest.mark.parametrize("rate, spm, marks", [(50, 80, ("<P>", "<S>", "<M>")), (100, 0, ("<P>", "<S>", "<M>")), (100, 100, ("|pre|", "|", "|mid"))])
def test_contract_and_round_trip(spark, rate, spm, marks):
    rows = [(k * 100 + i, t) for k in range(6) for i, t in enumerate(TEXTS)] + [(None, "without an id"), (7, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, output string")
    found = fill_in_middle.transform(docs, rate=rate, suffix_first_rate=spm, sentinels=marks)
    got = found.select("*", fill_in_middle.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    expected = [(i, *contract(i, t or "", rate, spm, marks), t or "") for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert {r.form for r in got} >= ({"plain", "spm", "psm"} if rate == 50 else {"plain"})


def test_long_text_and_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    got = fill_in_middle.transform(spark.createDataFrame([(k, long) for k in range(4)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *contract(k, long)) for k in range(4))
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, folder, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in fill_in_middle.op13_fill_in_middle(spark, folder).collect()}
    assert got == {i: (*(c := contract(i, t))[:4], sha(c[4]), sha(t)) for i, t in texts.items()}


def test_sentinels_are_checked():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("a b", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.event_automaton(marks)
