"""Helpers shared by the text operators: shared storage, text columns, naming."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Tells Spark to delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process,
    as in local tests, a folder of the driver's own takes its place.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"tracemill-{spark.sparkContext.applicationId}")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(own)
    return own


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a reliable lineage cut.

    Unlike a cache it survives lost executors, and unlike ``checkpoint()`` it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was else spark.conf.unset(_CLEANUP)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`store` that nothing will read again."""
    for frame in frames:
        path = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """From now on rows go to Python in Arrow batches of ``limit`` bytes, so that long texts don't add up; what a user has set stays."""
    if spark.conf.get(_BATCH_BYTES, None) == "67108864b":  # Spark's own default
        spark.conf.set(_BATCH_BYTES, str(limit))


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of ``limit`` bytes of a text or binary column, or of one row that has more."""
    for batch in batches:
        values = batch.column(column)
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1)
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that other letters keep their code points."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of the lower-cased words of a text; empty for an empty text."""
    return F.filter(F.split(ascii_lower(text), WORD_GAP), lambda w: w != "")


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text, the hash that fixes held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))
