"""Intermediate tables in the folder that driver and executors share: lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of the driver's own only where all of Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"tracemill-{spark.sparkContext.applicationId}")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back; its shuffle files go once it is written."""
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


def filesystem(spark: SparkSession, path: str):
    """(Hadoop's file system, path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, at = filesystem(spark, path)
        system.delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`store` that nothing will read again."""
    for frame in frames:
        delete(frame.sparkSession, frame._stored_at)
