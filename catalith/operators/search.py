"""Vector search: hashing embeddings, exact cosine top-k, fusion of spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import scalars

#: The length of a vector, and what is added to a token for each of its three buckets (fixed values).
DIM, SUFFIXES = 256, ("", "_2", "_3")


def embedded(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, bucket, weight``: the vector's non-zero parts, by one aggregation over exploded tokens."""
    each = texts.select(key, F.explode(scalars.tokens(F.col(text))).alias("w")).groupBy(key, "w").agg(F.log1p(F.count("*").cast("double")).alias("n"))
    spread = each.select(key, "n", F.explode(F.array(*(F.concat("w", F.lit(p)) for p in SUFFIXES))).alias("t")).withColumn("h", scalars.fnv(F.col("t")))
    sums = spread.groupBy(key, F.pmod(F.abs("h"), F.lit(DIM)).alias("bucket")).agg(F.sum(F.when(F.col("h") > 0, F.col("n")).otherwise(-F.col("n"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "bucket", F.when(norm > 0, F.col("v") / norm).otherwise(F.lit(0.0)).alias("weight"))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar vectors of the query's length; the filter comes before the limit; a zero query gives none."""
    rows = vectors if where is None else vectors.where(where)
    if not any(query):
        return rows.limit(0).select(key, F.lit(0.0).alias("score"))
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.select(key, scalars.cosine(F.col(vector), q).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), key).limit(k)


def fused(hits: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Hits (key, space, space_rank, score) of several spaces: scores scaled to 0..1 in their space (1 where all are equal), the best per key, the k best."""
    hits = hits.where(F.col("score") > 0)
    w = Window.partitionBy("space")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = hits.withColumn("fused", F.floor(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)) * 1000 + 0.5) / 1000)
    best = scaled.groupBy(key).agg(F.max_by(F.struct("fused", "space"), F.struct("fused", -F.col("space_rank"))).alias("b"))
    return best.select(key, F.col("b.space").alias("space"), F.col("b.fused").alias("score")).orderBy(F.desc("score"), key).limit(k)


def stats(vectors: DataFrame, space: Column, vector: str = "embedding") -> DataFrame:
    return vectors.groupBy(space.alias("space")).agg(F.count("*").alias("n"), F.min(F.size(vector)).cast("long").alias("dimensions"))
