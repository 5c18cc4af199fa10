"""Scratch tables in the cluster's shared folder, to cut the lineage of loops."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine, as in tests, a temporary one where it is unset.

    On a cluster a missing setting is an error: executors do not see each other's local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
        if not known and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = known.rsplit("/", 1)[0] if known else f"file://{tempfile.mkdtemp(prefix='catalith-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/catalith-{uuid.uuid4().hex}/{name}"
    _scratch.append((spark, path.rsplit("/", 1)[0]))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Files in the shared folder outlive the executors that wrote them, so a later
    read never depends on an executor that is gone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone by then
            return


atexit.register(_clean)
