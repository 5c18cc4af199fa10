"""Folder trees and links, by pointer doubling: rounds grow with the logarithm of the depth, and nothing limits it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.scratch import stored


def walked(folders: DataFrame, root: str | None = None, trail: bool = False) -> DataFrame:
    """For every folder: ``folder_id, top, depth, path`` (and ``trail``, its ancestors, itself first).

    ``top`` is the ancestor without a parent, or ``root``, above which nobody
    looks; a missing parent ends a walk like none.  Round k joins walks of 2**k
    steps to one another.  Every depth below the deepest is that of some folder,
    so that a round that ends no walk is the last one: what is left goes round in
    a cycle and has no row.
    """
    known = folders.select(F.col("folder_id").alias("up"))
    base = folders.select("folder_id", "name", F.when(F.lit(root).isNull() | (F.col("folder_id") != F.lit(root)), F.col("parent_id")).alias("up"))
    up = base.join(known.withColumn("there", F.lit(True)), "up", "left").withColumn("up", F.when(F.col("there"), F.col("up")))
    own = F.array(F.struct("folder_id", "name")) if trail else F.lit(None).cast("boolean")
    walks = stored(up.select("folder_id", "up", F.col("folder_id").alias("top"), F.lit(0).alias("depth"), F.concat(F.lit("/"), "name").alias("path"), own.alias("trail")), "walks")
    left = walks.where("up is not null").count()
    while left:
        far = walks.select(F.col("folder_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"), F.col("trail").alias("trail2"))
        more = F.col("top2").isNotNull()
        joined = walks.join(far, "up", "left").select(
            "folder_id", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), F.when(more, F.col("depth") + F.col("depth2") + 1).otherwise(F.col("depth")).alias("depth"),
            F.concat(F.coalesce("path2", F.lit("")), "path").alias("path"), (F.when(more, F.concat("trail", "trail2")).otherwise(F.col("trail")) if trail else F.col("trail")).alias("trail"),
        )
        walks = stored(joined, "walks")
        now = walks.where("up is not null").count()
        if now == left:
            break
        left = now
    return walks.where("up is null").select("folder_id", "top", "depth", "path", *(["trail"] if trail else []))


def absolute_paths(folders: DataFrame) -> DataFrame:
    """``folder_id, path, depth`` from every root down; an orphan counts as a root, a cycle has no path."""
    return walked(folders).select("folder_id", "path", "depth")


def subtree(folders: DataFrame, root: str) -> DataFrame:
    """A folder and all below it, with their depth; deletion goes by depth, the deepest first."""
    return walked(folders, root).where(F.col("top") == root).select("folder_id", "depth")


def breadcrumbs(folders: DataFrame, leaves: DataFrame) -> DataFrame:
    """For each leaf its ancestors, itself first; ends silently at a missing parent."""
    found = walked(folders, trail=True).join(leaves.select("folder_id"), "folder_id", "left_semi")
    return found.select(F.col("folder_id").alias("leaf"), F.posexplode("trail").alias("up", "x")).select("leaf", "x.folder_id", F.col("up").cast("int").alias("up"), "x.name")


def resolve_links(links: DataFrame, most: int = 40) -> DataFrame:
    """Links (path, target) followed to their ends; ELOOP after ``most`` hops.

    Each round doubles the hops taken, so that neither the levels nor the rows of a recursion bound the number of links.
    """
    walks = links.select("path", "target", F.lit(1).alias("hops"))
    for _ in range(most.bit_length()):
        on = walks.select(F.col("path").alias("__path"), F.col("target").alias("__target"), F.col("hops").alias("__hops"))
        far = walks.join(on, F.col("target") == F.col("__path"), "left")
        walks = stored(far.select("path", F.when(F.col("__path").isNull(), F.col("target")).otherwise(F.col("__target")).alias("target"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops")), "links")
    ends = walks.groupBy("path").agg(F.max("hops").alias("far"), F.max_by("target", "hops").alias("target"))
    lost = F.col("far") > most
    return ends.select("path", F.when(~lost, F.col("target")).alias("target"), F.least("far", F.lit(most)).alias("hops"), F.when(lost, "ELOOP").alias("error_code"))
