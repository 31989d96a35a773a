"""Fill-in-middle transformation: a document is cut into prefix, middle and suffix, and some are written with the middle last.

The cuts fall between units, a unit being a word with the white space before it, or white space at the end
of the text. One automaton finds every ASCII character that changes the class (white space) and every
sentinel in one pass. Between two such events lies a gap of other characters, and a gap that isn't empty
is the end of exactly one unit; so the events alone give the number of units and, by rank, where each
ends. No unit is ever built.

``suffix first`` (spm) and ``prefix first`` (psm) forms are read back by :func:`restored`, which needs the
text with its form only: a text that holds a sentinel is never transformed.

Defined cases: null text reads as empty and stays plain, as does a text that holds a sentinel; a document
without an id hashes as the seed and a colon alone; rows repeated with id and text come out alike; empty
tables give empty results; other columns, whatever their names, are ignored. Memory: one text and 8 bytes
for each of its events.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, in_chunks, text_of

SPACES = " \t\n\v\f\r"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SUFFIX_FIRST_RATE = 42, 50, 80
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def event_automaton(sentinels: tuple[str, str, str] = SENTINELS) -> ahocorasick.Automaton:
    """Finds white space (value 0) and sentinels (value 1)."""
    if len(set(sentinels)) < 3 or any(not s or set(s) & set(SPACES) for s in sentinels):
        raise ValueError("three different sentinels without white space are needed")
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for character in SPACES:
        found.add_word(character, 0)
    for sentinel in sentinels:
        found.add_word(sentinel, 1)
    found.make_automaton()
    return found


def unit_ends(text: str, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether the text holds a sentinel."""
    events = np.fromiter((2 * end + kind for end, kind in automaton.iter(text)), np.int64)
    spaces = events[(events & 1) == 0] >> 1
    edges = np.concatenate(([-1], spaces, [len(text)]))
    ends = edges[1:][np.diff(edges) > 1]
    if len(spaces) and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(spaces) < len(events)


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four numbers of 32 bits that seed and id hash to."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _transformed(seed: int, rate: int, suffix_first_rate: int, sentinels: tuple[str, str, str]):
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton(sentinels)
        for batch in in_chunks(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ends, marked = unit_ends(text, automaton)
                n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
                if not text or marked or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                if h4 % 100 < suffix_first_rate:
                    rows.append((n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))))
                else:
                    rows.append((n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first_rate: int = SUFFIX_FIRST_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``rate`` of a hundred documents are transformed, of which ``suffix_first_rate`` of a hundred have the
    suffix first. The cuts follow from seed and id, so a task that runs again gives the same rows.
    """
    event_automaton(sentinels)  # an error in them shows here
    bound_batches(docs.sparkSession)
    slim = docs.select("doc_id", text_of().alias("text"))
    return slim.mapInArrow(_transformed(seed, rate, suffix_first_rate, sentinels), f"doc_id {dict(slim.dtypes)['doc_id']}, {_SCHEMA}")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    p, s, m = sentinels

    def rebuilt(first: str, second: str, prefix_first: bool) -> Column:
        at = F.position(F.lit(second), output)
        then = F.position(F.lit(m), output, at + len(second))
        parts = (F.substr(output, F.lit(len(first) + 1), at - 1 - len(first)), F.substr(output, at + len(second), then - at - len(second)), F.substr(output, then + len(m)))
        prefix, suffix = parts[:2] if prefix_first else (parts[1], parts[0])
        return F.concat(prefix, parts[2], suffix)

    return F.when(form == "psm", rebuilt(p, s, True)).when(form == "spm", rebuilt(s, p, False)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return transform(documents(spark, sf_dir)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM hashed
), cuts AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
