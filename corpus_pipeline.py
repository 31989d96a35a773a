"""Corpus pipeline: each stage works on the documents that the stage before it kept.

Stages 1 to 4 return the columns of ``documents``; the last returns the packed pieces. Defined cases:
documents without an id pass every stage that decides by id, and of rows repeated with id and text the
near-duplicate stage keeps one; documents whose lines all go stay, with empty text; columns beyond those
of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontamination, lines, near_duplicates, packing, shingles, toxicity
from tracemill.llm.common import store, text_of


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold, by a model of the labelled documents among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, docs.columns).where(F.col("score") < toxicity.THRESHOLD).select("kept.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    changed = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return lines.clean(docs).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates on five-word shingles.

    Of rows that repeat an id with its text the one with the least hash of all columns stays; rows without
    an id stay. Only rows that repeat are gathered, and folded where they lie.
    """
    found = near_duplicates.near_duplicates(docs, size=shingles.SIZE)
    dropped = store(found.where("NOT kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"))
    kept = packed.join(dropped, F.col("id") == F.col("dropped"), "left_anti")
    counted = kept.where("id IS NOT NULL").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = store(counted.where("n > 1").select("id", "text_hash"), "repeated")
    single = kept.join(repeated, ["id", "text_hash"], "left_anti")
    folded = kept.join(repeated, ["id", "text_hash"]).groupBy("id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.select("row.*").unionAll(folded.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text_of()))
    found = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = store(found.select(F.col("doc_id").alias("held")).distinct(), "held")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    return packed.join(held, F.col("key") == F.col("held"), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the trained classifier, the fingerprints or the packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "-"))
    return docs
