"""Shared helpers: scratch tables in the cluster's shared folder, and text conventions."""

from __future__ import annotations

import atexit
import functools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.scratch import scratch_path, shared_dir, stored

__all__ = ["SPACE_CLASS", "WORD_CLASS", "bucketed", "reduced", "scratch_path", "shared_dir", "stored", "table", "whole"]

#: White space that separates words; everything else is part of a word (fixed values).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_tables: list[tuple[SparkSession, str]] = []


def bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """As ``stored``, but as a table in the warehouse, in ``n`` buckets by ``column``: a later join by it does not shuffle these rows."""
    spark, name = df.sparkSession, f"catalith_{uuid.uuid4().hex}"
    _tables.append((spark, name))
    df.write.format("parquet").option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    return spark.table(name)


def _clean() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be gone by then
            break


atexit.register(_clean)


def reduced(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], combine: Callable = np.add) -> np.ndarray | None:
    """The numbers that ``of`` makes of each batch of rows, combined over all; null without rows.  One vector of each task reaches the driver.

    Where the numbers are multiples of one power of two, and below 2**53 of it,
    their sum is exact, so that neither partitions nor batches decide the result.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else combine(total, of(b))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], ["v"])

    parts = [np.frombuffer(r.v) for r in df.mapInArrow(run, "v binary").collect()]
    return functools.reduce(combine, parts) if parts else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(col, F.lit(""))
