"""Document fingerprints: bottom-k sketches of word-shingle hashes. DataFrame functions only.

A sketch is the k smallest distinct hashes of a document's shingles, ascending. The sketch of a union is
the k smallest of the two sketches' union, so sketches of parts merge without their texts. They
estimate resemblance, containment and the number of distinct shingles; sets of at most k are exact.

Finding the next document in id order takes no global sort: ids fall into ranges of ``RANGE`` and the
window runs within a range; only the first text of each range goes to the range before, and ranges are
chained the same way, two levels up, where one row stands for millions of ids.

Defined cases: null text reads as empty, whose sketch is empty; two empty sketches have likeness 1, an
empty and another one 0; rows without an id come first in the order, rows with the same id follow one
another by text, equal texts in any order; a single document is its own next; equal texts have equal
fingerprints; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, words_of
from .shingles import SIZE, shingle_hashes

K, RANGE = 128, 64
_LOWEST = -(1 << 62)


def sketch(words: Column, k: int = K, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words, size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both sets hold."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(merge(a, b, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of hash space the sketch spans."""
    span = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """(doc_id, sketch, n_shingles estimate) of every document."""
    worded = docs.select("doc_id", words_of(text_of()).alias("words"))
    return worded.select("doc_id", sketch(F.col("words"), k, size).alias("sketch")).select("doc_id", "sketch", distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def _next_range(ranges: DataFrame, fan: int = 1 << 20) -> DataFrame:
    """(range, next): the next range that has rows, or null after the last; ``ranges`` has each range once."""
    grouped = ranges.select("range", F.floor(F.col("range") / fan).alias("group"))
    own = grouped.select("*", F.lead("range").over(Window.partitionBy("group").orderBy("range")).alias("own_next"))
    heads = grouped.groupBy("group").agg(F.min("range").alias("head"))
    # One row for fan * RANGE ids: small enough for one task at any corpus size.
    chained = heads.select("group", F.lead("head").over(Window.orderBy("group")).alias("over_next"))
    return own.join(chained, "group").select("range", F.coalesce("own_next", "over_next").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each document with the text of the next one by id; after the last comes the first."""
    ranged = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(_LOWEST)).alias("range"))
    order = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "text")
    local = ranged.select("*", F.lead("text").over(order).alias("inner_next"), F.row_number().over(order).alias("rank"))
    heads = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(_LOWEST)).alias("range"))
    head = heads.groupBy("range").agg(F.min_by("text", F.struct("doc_id", "text")).alias("head_text"))
    ranges = docs.select(F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(_LOWEST)).alias("range")).distinct()
    first = ranges.agg(F.min("range").alias("first"))
    links = _next_range(ranges).crossJoin(first).select("range", F.coalesce("next", "first").alias("next"))
    after = links.join(head.withColumnRenamed("range", "next"), "next").select("range", "head_text")
    return local.join(after, "range").select("doc_id", "text", F.coalesce("inner_next", "head_text").alias("next_text"))


def written(sketch_column: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch_column, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(documents(spark, sf_dir))
    n = F.char_length("text")
    taken = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - taken), F.substr("next_text", F.lit(1), taken))
    texts = docs.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_text")
    worded = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), words_of(F.col("text")).alias("words"), words_of(F.col("edited")).alias("edited_words"), words_of(F.col("next_text")).alias("next_words"))
    s = worded.select("doc_id", "n_chars", "edited_sha256", sketch(F.col("words")).alias("own"), sketch(F.col("edited_words")).alias("edited"), sketch(F.col("next_words")).alias("next"))
    near = [resemblance(F.col("own"), F.col(c)).alias(f"near_{c}") for c in ("edited", "next")]
    return s.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"), *near, distinct_shingles(F.col("own")).alias("n_shingles"))
