"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Connect the neighbours of every vertex to the least of them and itself.

    The large step moves larger neighbours only, the small step smaller ones.
    The least neighbour is found by an aggregation that combines before its
    shuffle, so that a vertex with very many neighbours is no hot task there;
    the join that follows is an ordinary one, whose large partitions Spark splits.
    """
    both = edges.select("a", "b") if small else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return moved.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``vertex, component`` for every vertex of the edges ``a, b`` (long); a component is named by its least vertex.

    Lineage is cut after each round by a table in the shared folder; only three
    numbers a round reach the driver.  Self loops and repeated edges are allowed;
    no edges give no rows.
    """
    edges = stored(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        edges = stored(_star(_star(edges, small=False), small=True), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
