"""Sources and sinks: files as binary rows, snapshots that are never overwritten in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder as (path, name, data, size, mtime_ms)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("content").alias("data"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write to a fresh folder below ``root`` and return it: what is being read is never overwritten."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def exported(df: DataFrame, root: str, kind: str) -> str:
    """Rows written as json, csv (with a header) or parquet to a fresh folder below ``root``, which is returned."""
    path = f"{root.rstrip('/')}/export-{uuid.uuid4().hex}"
    df.write.format(kind).option("header", "true").save(path)
    return path
