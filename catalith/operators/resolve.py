"""Paths to nodes: resolution with its error codes, links, and what is asked of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions import scalars
from catalith.operators.listing import visible
from catalith.scratch import stored

#: Links followed at most (fixed value).
MOST_HOPS = 40


def resolve(asked: DataFrame, folder_paths: DataFrame, files: DataFrame) -> DataFrame:
    """For (pos, path): ``kind`` (dir, file, symlink, ENOTDIR, ENOENT), the node's id and a link's target.

    ``folder_paths`` has (folder_id, path), ``files`` (file_id, parent_id,
    file_name, status, and for links link_target).  The longest beginning of a
    path that is a folder decides: a file wins over a folder at the end, a file
    before the end is ENOTDIR, and what is missing ENOENT.  Of equal names the
    least id is taken.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = asked.select("pos", "path", segments.alias("segs"))
    prefix = F.concat(F.lit("/"), F.array_join(F.slice("segs", F.lit(1), F.col("k")), "/"))
    each = rows.select("pos", "segs", F.explode(F.sequence(F.lit(0), F.size("segs"))).alias("k")).withColumn("prefix", prefix)
    known = folder_paths.groupBy("path").agg(F.min("folder_id").alias("folder_id")).withColumnRenamed("path", "prefix")
    there = each.join(known, "prefix", "left").where((F.col("k") == 0) | F.col("folder_id").isNotNull())
    inner = F.when(F.col("k") < F.size("segs"), F.struct("k", F.coalesce("folder_id", F.lit("")).alias("id")))
    found = there.groupBy("pos").agg(F.max(inner).alias("last"), F.max(F.when(F.col("k") == F.size("segs"), F.col("folder_id"))).alias("dir"))
    at = rows.join(found, "pos").select("pos", "path", F.size("segs").alias("n"), "last.k", F.col("last.id").alias("parent"), F.get("segs", F.col("last.k")).alias("name"), "dir")
    target = F.col("link_target") if "link_target" in files.columns else F.lit(None).cast("string")
    named = files.where("status <> 'deleted'").groupBy(F.coalesce("parent_id", F.lit("")).alias("parent"), F.col("file_name").alias("name")).agg(F.min(F.struct("file_id", target.alias("target"))).alias("f"))
    out = at.join(named, ["parent", "name"], "left")
    leaf = F.col("k") == F.col("n") - 1
    kind = (
        F.when(F.col("n") == 0, "dir").when(leaf & F.col("f.target").isNotNull(), "symlink").when(leaf & F.col("f").isNotNull(), "file")
        .when(F.col("dir").isNotNull(), "dir").when(~leaf & F.col("f").isNotNull(), "ENOTDIR").otherwise("ENOENT")
    )
    out = out.withColumn("kind", kind)
    node = F.when(F.col("kind").isin("file", "symlink"), F.col("f.file_id")).when(F.col("kind") == "dir", F.coalesce("dir", F.lit("")))
    return out.select("pos", "path", "kind", node.alias("node"), F.when(F.col("kind") == "symlink", F.col("f.target")).alias("target"))


def followed(asked: DataFrame, folder_paths: DataFrame, files: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """As ``resolve``, with links at the end followed; ELOOP after ``most`` hops.

    Only rows that still are links are resolved again.  A row that comes back to
    a place it has marked goes round for ever, and is ELOOP at once.
    """
    lost = lambda df: df.select("pos", "path", F.lit("ELOOP").alias("kind"), F.lit(None).cast("string").alias("node"))
    done, left = None, asked.select("pos", "path", F.col("path").alias("now"), F.lit(None).cast("string").alias("mark"))
    for hop in range(most):
        found = resolve(left.select("pos", F.col("now").alias("path")), folder_paths, files).withColumnRenamed("path", "at")
        absolute = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(F.regexp_replace("at", "/[^/]*$", ""), F.lit("/"), "target"))
        mark = F.col("at") if hop & (hop - 1) == 0 else F.col("mark")  # after 1, 2, 4, ... hops
        found = stored(left.select("pos", "path", "mark").join(found, "pos").withColumns({"mark": mark, "next": scalars.normalize(absolute)}), "resolved")
        ended = found.where("kind <> 'symlink'").select("pos", "path", "kind", "node")
        ended = ended.union(lost(found.where("kind = 'symlink' AND next = mark")))
        done = ended if done is None else done.union(ended)
        left = found.where("kind = 'symlink' AND (mark IS NULL OR next <> mark)").select("pos", "path", F.col("next").alias("now"), "mark")
        if left.isEmpty():
            return done
    return done.union(lost(left))


def stats(resolved: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """Resolved paths with ``exists``, size, time and the error code of a stat; a tombstoned file is ENOENT."""
    seen = visible(files, versions).select(F.col("file_id").alias("node"), F.coalesce("head_size", "file_size").alias("size"), F.coalesce("head_mtime", "updated_at").alias("mtime"), F.lit(True).alias("seen"))
    out = resolved.join(seen, "node", "left")
    code = F.when(F.col("kind").isin("ENOENT", "ENOTDIR", "ELOOP"), F.col("kind")).when((F.col("kind") == "file") & F.col("seen").isNull(), "ENOENT")
    of_file = lambda c: F.when(code.isNull() & (F.col("kind") == "file"), F.col(c)).alias(c)
    return out.select("pos", "path", F.when(code.isNull(), F.col("kind")).alias("kind"), code.isNull().alias("exists"), of_file("size"), of_file("mtime"), code.alias("error_code"))


def readlinks(resolved: DataFrame) -> DataFrame:
    """Resolved paths, not followed, with a link's target; EINVAL for what is no link."""
    code = F.when(F.col("kind").isin("ENOENT", "ENOTDIR"), F.col("kind")).when(F.col("kind") != "symlink", "EINVAL")
    return resolved.select("pos", "path", F.when(code.isNull(), F.col("target")).alias("target"), code.alias("error_code"))


def cache_key(files: DataFrame) -> DataFrame:
    """What a cached answer of a file depends on."""
    return files.select("file_id", F.concat_ws(":", "file_id", F.coalesce("head_version_id", F.lit("-")), F.col("updated_at").cast("string")).alias("cache_key"))
