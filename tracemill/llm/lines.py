"""Boilerplate lines by site-relative frequency. DataFrame functions only.

Pages are grouped by host (for ``documents``: the source). For each line, the pages of the host that
hold it are divided by the host's pages; a line above ``ratio`` is boilerplate there and goes from every
page of the host. Every row is a page, copies included. ``min_pages`` only says what a repeated line is:
on a host of a few pages, a line on one page would be above any ratio.

Counts are partial aggregates over (host, line hash), so neither a hot host nor a hot line meets in one
task. A host has fewer boilerplate lines than its lines per page divided by the ratio, so they fit one
row per host. That table is stored, and Spark broadcasts it if it is small or else joins by shuffle.

Defined cases: null host is a host of its own; null text reads as empty; blank lines are never counted
or dropped; lines compare without spaces around them; a line exactly at the ratio stays; a page whose
lines all go stays, with empty text; repeated rows, with or without an id, count as pages each and are
all cleaned; an empty table gives an empty result; other columns, whatever their names, pass through
:func:`clean` in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, store

RATIO, MIN_PAGES = 0.1, 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): the hashes of the boilerplate lines of each host that has any. ``pages``: host, text."""
    filled = F.filter(F.transform(_lines(F.col("text")), lambda s: F.trim(s)), lambda s: s != "")
    held = pages.select("host", F.explode(F.array_distinct(F.transform(filled, lambda s: F.xxhash64(s)))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    return often.join(total, "host").where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def clean(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source") -> DataFrame:
    """(row, n_lines, n_dropped, cleaned): the row as a struct, its lines that aren't blank, those of them that go, and its text without them."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[host].cast("string"), F.lit("\0")).alias("host"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    lines_of_host = store(boilerplate(packed.select("host", "text"), ratio, min_pages), "boilerplate")
    none = F.array().cast("array<bigint>")
    joined = packed.join(lines_of_host, "host", "left").select("row", _lines(F.col("text")).alias("lines"), F.coalesce("drop", none).alias("drop"))
    stays = F.filter("lines", lambda s: (F.trim(s) == "") | ~F.array_contains("drop", F.xxhash64(F.trim(s))))
    filled = F.size(F.filter("lines", lambda s: F.trim(s) != ""))
    return joined.select("row", filled.cast("long").alias("n_lines"), (F.size("lines") - F.size(stays)).cast("long").alias("n_dropped"), F.array_join(stays, "\n").alias("cleaned"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = documents(spark, sf_dir).select("doc_id", "source", "text")
    return clean(slim).select("row.doc_id", "row.source", "n_lines", "n_dropped", F.col("cleaned").alias("text"))


OP4_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, source, coalesce(text, '') AS text FROM documents),
held AS (SELECT DISTINCT page, source, trim(line) AS line
         FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS line FROM pages) WHERE trim(line) <> ''),
often AS (SELECT source, line, count(*) AS n FROM held GROUP BY source, line HAVING count(*) >= {MIN_PAGES}),
total AS (SELECT source, count(*) AS total FROM pages GROUP BY ALL),
boiler AS (SELECT o.source, list(line) AS drop FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source
           WHERE n > {RATIO} * total GROUP BY o.source),
lined AS (SELECT d.doc_id, d.source, string_split(coalesce(d.text, ''), chr(10)) AS lines, coalesce(b.drop, []) AS drop
          FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, len(list_filter(lines, lambda s: trim(s) <> '')) AS n_lines,
       len(list_filter(lines, lambda s: trim(s) <> '' AND list_contains(drop, trim(s)))) AS n_dropped,
       coalesce(array_to_string(list_filter(lines, lambda s: trim(s) = '' OR NOT list_contains(drop, trim(s))), chr(10)), '') AS text
FROM lined
"""
