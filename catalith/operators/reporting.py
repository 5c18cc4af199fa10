"""Reports: counts by status, type and shard, dedup ratios, shares, date groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import scalars

STATUSES = ("uploading", "processing", "complete", "failed")


def rounded(x: Column, places: int) -> Column:
    """Half goes up, towards positive infinity."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def by_status(files: DataFrame) -> DataFrame:
    """One row with a column for each known status; others are left out."""
    return files.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES))


def by_mime(files: DataFrame) -> DataFrame:
    return files.groupBy("mime_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def shard_distribution(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    rows = chunks.join(files, "file_id", "left_semi") if files is not None else chunks
    return rows.groupBy("shard_index").agg(F.count("*").alias("chunks"), F.sum("chunk_size").alias("bytes"))


def store(refs: DataFrame, deleted: Column) -> DataFrame:
    """The chunk store that references imply: a row for each shard and hash, with size, references and a deletion mark."""
    return refs.groupBy("shard_index", "chunk_hash").agg(F.max("chunk_size").alias("size"), F.count("*").alias("ref_count")).withColumn("deleted", deleted)


def dedup(chunks: DataFrame) -> DataFrame:
    """Per shard and in all (shard -1): chunks, bytes, references and the share of references that cost nothing; marked chunks count."""
    each = chunks.groupBy("shard_index").agg(F.count("*").alias("u"), F.sum("size").alias("bytes"), F.sum("ref_count").alias("refs"))
    total = each.agg(F.sum("u").alias("u"), F.sum("bytes").alias("bytes"), F.sum("refs").alias("refs")).select(F.lit(-1).cast("long").alias("shard_index"), "u", "bytes", "refs")
    ratio = F.when(F.col("refs") > 0, rounded(1 - F.col("u") / F.col("refs"), 4)).otherwise(F.lit(0.0))
    return each.withColumn("shard_index", F.col("shard_index").cast("long")).unionByName(total).select("shard_index", F.col("u").alias("chunks"), "bytes", "refs", ratio.alias("ratio"))


def live_bytes(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("deleted")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recent(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.desc("created_at"), "file_id").limit(n).select("file_id", "file_name", "status", "created_at")


def shares(files: DataFrame, limit_bytes: int = 100 << 30) -> DataFrame:
    """Users' bytes, share of all bytes, height against the largest, and share of their limit, in per cent; the totals are two scalars."""
    each = files.groupBy("user_id").agg(F.sum("file_size").alias("bytes"))
    every, most = each.agg(F.sum("bytes")).scalar(), each.agg(F.max("bytes")).scalar()
    return each.select("user_id", "bytes", rounded(100.0 * F.col("bytes") / every, 2).alias("share"), rounded(100.0 * F.col("bytes") / most, 2).alias("height"), rounded(100.0 * F.col("bytes") / limit_bytes, 6).alias("quota"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def date_groups(rows: DataFrame, millis: str, now_ms: int) -> DataFrame:
    """Rows by UTC day with its label: Today, Yesterday, a weekday within six days, a date."""
    day = F.to_date(F.timestamp_millis(F.col(millis)))
    today = F.to_date(F.timestamp_millis(F.lit(now_ms)))
    age = F.datediff(today, F.col("day"))
    same_year = F.year("day") == F.year(today)
    label = F.when(age == 0, "Today").when(age == 1, "Yesterday").when((age > 1) & (age < 7), F.date_format("day", "EEEE")).when(same_year, F.date_format("day", "MMMM d")).otherwise(F.date_format("day", "MMMM d, yyyy"))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), label.alias("label"), "n")


def nearest_rank(values: DataFrame, group: str, order: str, value: str, q: float, ring: int = 32) -> DataFrame:
    """The quantile of each group's last ``ring`` values: of n sorted ones that at floor(q n), from 0."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    last = values.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ring)
    a = last.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = F.least(F.size("v"), F.floor(F.lit(q) * F.size("v")).cast("int") + 1)
    return a.select(group, F.size("v").alias("n"), F.element_at("v", at).alias("q"))


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def total_files(files: DataFrame, counters: DataFrame) -> DataFrame:
    """Users' files: those that are there, or what the counter says if that is more."""
    each = files.where("status <> 'deleted'").groupBy("user_id").agg(F.count("*").alias("actual"))
    return each.join(counters, "user_id", "left").select("user_id", F.greatest("actual", F.coalesce("counter", F.lit(0))).alias("total"))


def grown_pool(shards: DataFrame, full_bytes: int) -> DataFrame:
    """Shards (shard_index, bytes) with the size of their pool: by all bytes, and one more when every shard is full."""
    every, least = shards.agg(F.sum("bytes")).scalar(), shards.agg(F.min("bytes")).scalar()
    return shards.withColumn("pool", scalars.pool_size(every) + (least > full_bytes).cast("int"))
