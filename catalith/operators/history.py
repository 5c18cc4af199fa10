"""Version histories: heads, retention, repair, tombstones, restore, audit retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _newest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("mtime_ms"), F.desc("version_id"))


def heads(versions: DataFrame) -> DataFrame:
    """The newest version of every path, deleted or not."""
    return versions.groupBy("path_id").agg(F.max_by(F.struct("version_id", "mtime_ms", "size", "deleted"), F.struct("mtime_ms", "version_id")).alias("h")).select("path_id", "h.*")


def latest_live(versions: DataFrame) -> DataFrame:
    """The newest version of every path that is not a tombstone."""
    return heads(versions.where(~F.col("deleted")))


def list_versions(versions: DataFrame, visible_only: bool = False, limit: int = 1000) -> DataFrame:
    """Every path's versions with their place, the newest first."""
    rows = versions.where("user_visible") if visible_only else versions
    return rows.withColumn("place", F.row_number().over(_newest("path_id"))).where(F.col("place") <= limit)


def as_of(versions: DataFrame, at_ms: int) -> DataFrame:
    """Each path as it was: the newest version by then, unless that is a tombstone."""
    return heads(versions.where(F.col("mtime_ms") <= at_ms)).where(~F.col("deleted"))


def dropped(versions: DataFrame, pointers: DataFrame, older_than: int | None = None, keep_last: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The versions that a retention policy drops, by head ``pointers`` (path_id, head_version_id).

    A path's head stays whatever version it is, and takes one of the places of
    ``keep_last``; those of ``keep`` stay, too, but take none.  A cutoff of 0 is none.
    """
    rows = versions.join(pointers.select("path_id", F.col("head_version_id").alias("__head")), "path_id", "left")
    safe = F.coalesce(F.col("version_id") == F.col("__head"), F.lit(False)) | F.col("version_id").isin(keep or [])
    places = F.greatest(F.lit(keep_last or 0) - F.col("__head").isNotNull().cast("int"), F.lit(0))
    newest = Window.partitionBy("path_id", "__safe").orderBy(F.desc("mtime_ms"), F.desc("version_id"))
    ranked = rows.withColumn("__safe", safe).withColumn("__place", F.row_number().over(newest))
    out = ranked.where(~F.col("__safe") & (F.col("__place") > places))
    if older_than:
        out = out.where(F.col("mtime_ms") < older_than)
    return out.select(versions.columns)


def repaired_heads(pointers: DataFrame, left: DataFrame) -> DataFrame:
    """Head pointers after versions went: kept if it is still there, else the newest left; paths without versions go."""
    newest = heads(left).select("path_id", F.col("version_id").alias("newest"))
    there = left.select("path_id", F.col("version_id").alias("head_version_id"), F.lit(True).alias("there"))
    out = pointers.join(newest, "path_id").join(there, ["path_id", "head_version_id"], "left")
    return out.select("path_id", F.when(F.col("there"), F.col("head_version_id")).otherwise(F.col("newest")).alias("head_version_id"))


def tombstoned(versions: DataFrame) -> DataFrame:
    """Paths whose head is a tombstone, and the live version to walk back to, if any."""
    dead = heads(versions).where("deleted").select("path_id", F.col("version_id").alias("tombstone"))
    back = latest_live(versions).select("path_id", F.col("version_id").alias("walk_back"))
    return dead.join(back, "path_id", "left")


def restored(versions: DataFrame, asked: DataFrame, now_ms: int, new_id: str, alive: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The histories with a copy of each asked (path_id, version_id) as the new head, and each request's outcome.

    ENOENT: no such version; EINVAL: a tombstone; ENOCHUNK: one of its chunks is
    not among the (path_id, version_id) whose chunks are all alive.  The copy is
    hidden from visible listings.
    """
    there = versions.withColumn("there", F.lit(True))
    found = asked.select("path_id", "version_id").join(there, ["path_id", "version_id"], "left")
    if alive is not None:
        found = found.join(alive.select("path_id", "version_id", F.lit(True).alias("alive")), ["path_id", "version_id"], "left")
    lost = F.col("alive").isNull() if alive is not None else F.lit(False)
    found = found.withColumn("code", F.when(F.col("there").isNull(), "ENOENT").when(F.col("deleted"), "EINVAL").when(lost, "ENOCHUNK").otherwise("OK"))
    new = found.where("code = 'OK'").withColumns({"version_id": F.lit(new_id), "mtime_ms": F.lit(now_ms).cast("long"), "user_visible": F.lit(False)})
    return versions.unionByName(new.select(versions.columns)), found.select("path_id", "version_id", "code")


def version_of(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """For (path_id, version_id): that version, or without an id the newest live one; ENOENT where there is none or it is a tombstone."""
    rows = versions.select("path_id", "version_id", F.col("version_id").alias("found"), "mtime_ms", "size", "deleted")
    named = asked.where("version_id is not null").join(rows, ["path_id", "version_id"], "left")
    newest = latest_live(versions).withColumnRenamed("version_id", "found")
    latest = asked.where("version_id is null").join(newest, "path_id", "left")
    out = named.unionByName(latest.select(named.columns))
    code = F.when(F.col("found").isNull() | F.col("deleted"), "ENOENT")
    ok = lambda c: F.when(code.isNull(), F.col(c)).alias(c)
    return out.select("path_id", "version_id", ok("found"), ok("mtime_ms"), ok("size"), code.alias("error_code"))


def marked(versions: DataFrame, marks: DataFrame) -> DataFrame:
    """Versions after marks (path_id, version_id, visible, label): once visible, a version stays so; a null label leaves the old one."""
    m = marks.select("path_id", "version_id", F.col("visible").alias("__visible"), F.col("label").alias("__label"))
    out = versions.join(m, ["path_id", "version_id"], "left")
    return out.withColumns({"user_visible": F.col("user_visible") | F.coalesce("__visible", F.lit(False)), "label": F.coalesce("__label", "label")}).drop("__visible", "__label")


def committed(versions: DataFrame, pointers: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histories after commits, one a path, and each path's account: its head, bytes and files added.

    ``new`` has (path_id, version_id, mtime_ms, size, deleted, user_visible) and,
    for a checked commit, ``expected``: it applies only if the head is that one
    (null: any).  A live commit adds its bytes; a file is added when a path turns
    live and taken when it turns to a tombstone.
    """
    was = versions.select("path_id", F.col("version_id").alias("head_version_id"), F.col("deleted").alias("was_deleted"))
    heads_now = pointers.join(was, ["path_id", "head_version_id"], "left").select("path_id", "head_version_id", F.coalesce(F.col("was_deleted"), F.lit(True)).alias("was_deleted"))
    asked = new.join(heads_now, "path_id", "left").withColumn("was_deleted", F.coalesce("was_deleted", F.lit(True)))
    ok = F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("head_version_id"))
    asked = asked.withColumn("committed", ok)
    added = F.when(F.col("committed") & ~F.col("deleted"), F.col("size")).otherwise(0)
    files = F.when(~F.col("committed"), 0).otherwise(F.col("was_deleted").cast("int") - F.col("deleted").cast("int"))
    account = asked.select("path_id", F.when(F.col("committed"), F.col("version_id")).otherwise(F.col("head_version_id")).alias("head_version_id"), "committed", added.cast("long").alias("bytes_added"), files.alias("files_added"))
    return versions.unionByName(asked.where("committed").select(versions.columns)), account


def audit_kept(audit: DataFrame, cap: int = 10_000, floor: int = 9_800) -> DataFrame:
    """Per actor: all rows up to the cap; beyond it the newest ``floor``."""
    sizes = audit.groupBy("actor").agg(F.count("*").alias("total"))
    newest = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("ts"), F.desc("id")))
    return audit.join(sizes, "actor").withColumn("place", newest).where((F.col("total") <= cap) | (F.col("place") <= floor)).drop("total", "place")


def reclaimed(versions: DataFrame, gone: DataFrame) -> DataFrame:
    return gone.groupBy("path_id").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("deleted"), F.col("size")).otherwise(0)).alias("bytes"))


def audited(audit: DataFrame, new: DataFrame) -> DataFrame:
    """The log with more entries; columns that they lack are null."""
    return audit.unionByName(new, allowMissingColumns=True)


def moved(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Histories after renames (source, target): a target keeps its own versions and takes over the source's; of equal ids the source's stays."""
    p = pairs.select(F.col("source").alias("path_id"), "target")
    taken = versions.join(p, "path_id").withColumn("path_id", F.col("target")).select(versions.columns)
    rest = versions.join(p.select("path_id"), "path_id", "left_anti")
    return rest.join(taken.select("path_id", "version_id"), ["path_id", "version_id"], "left_anti").select(versions.columns).unionByName(taken)


def unlinked_by_user(versions: DataFrame, paths: DataFrame, flags: DataFrame, now_ms: int, tombstone_id: str) -> DataFrame:
    """Histories after unlinks (path_id, user_id): a tombstone where the user's flag keeps versions (``flags``: user_id, enabled), else no history at all."""
    on = paths.join(flags.where("enabled").select("user_id"), "user_id", "left_semi").select("path_id")
    off = paths.join(flags.where("enabled").select("user_id"), "user_id", "left_anti").select("path_id")
    stones = on.select("path_id", F.lit(tombstone_id).alias("version_id"), F.lit(now_ms).cast("long").alias("mtime_ms"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("deleted"), F.lit(False).alias("user_visible"))
    return versions.join(off, "path_id", "left_anti").select(stones.columns).unionByName(stones)
