"""Streams give what the batch folds give."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith import streaming
from catalith.operators import folds
from catalith.sources import read_files, write_snapshot


def test_token_bucket_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{k % 3}", 37 * k) for k in range(60)], "user_id string, at_ms long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.token_bucket(stream, rate=5.0, burst=4.0).writeStream.outputMode("update").format("memory").queryName("bucket").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: (r.granted, r.refused) for r in spark.table("bucket").collect()}
    want = folds.token_bucket(rows, "user_id", "at_ms", 5.0, 4.0)
    assert got == {r.user_id: (r.granted, r.refused) for r in want.collect()}


def test_windows_drop_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:10:00", 4.0)], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_equal_requests_within_a_window_are_one(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:10:01"), ("b", "2024-01-01 00:10:02")], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming.distinct_within(stream, "path").writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.path for r in spark.table("once").collect()) == ["a", "b"]


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    row = read_files(spark, f"{tmp_path}/d").first()
    assert (row.name, bytes(row.data), row["size"]) == ("x.bin", b"abc", 3)
    df = spark.range(3)
    a, b = write_snapshot(df, f"{tmp_path}/s"), write_snapshot(df, f"{tmp_path}/s")
    assert a != b and spark.read.parquet(a).count() == 3
