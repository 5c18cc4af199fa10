"""Mutations as functions from a snapshot and commands to the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The first writer wins; of several new rows of a key, that with the least ``order`` (without one, the least of its other columns)."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        first = F.min_by(F.struct(*rest), order) if order else F.min(F.struct(*rest))
        new = new.groupBy(*keys).agg(first.alias("__r")).select(*keys, "__r.*").select(*new.columns)
    else:
        new = new.distinct()
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last writer wins; of several new rows of a key, that with the greatest ``order``."""
    if order:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*new.columns)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def published(rows: DataFrame) -> DataFrame:
    """Of rows with one user, parent and name the newest is live and takes over metadata that it lacks from the next; others are superseded."""
    w = Window.partitionBy("user_id", F.coalesce("parent_id", F.lit("")), "file_name").orderBy(F.desc("updated_at"), F.desc("file_id"))
    return rows.withColumn("metadata", F.coalesce("metadata", F.lead("metadata").over(w))).withColumn("live", F.row_number().over(w) == 1)


def deduplicated(rows: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """What happens to rows of one user, parent and name: the newest stays, others go; folders that have children are skipped.

    Rows with a ``status`` of deleted are in no group and stay as they are.
    """
    live = F.col("status") != "deleted" if "status" in rows.columns else F.lit(True)
    w = Window.partitionBy("user_id", F.coalesce("parent_id", F.lit("")), "name", live).orderBy(F.desc("updated_at"), F.desc("id"))
    out = rows.withColumn("place", F.row_number().over(w))
    action = F.when(~live | (F.col("place") == 1), "keep")
    if children is not None:
        out = out.join(children.select(F.col("parent_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
        action = action.when(F.col("has"), "skip")
    return out.withColumn("action", action.otherwise("drop")).drop("place", *(["has"] if children is not None else []))


def removed(files: DataFrame, folders_gone: DataFrame) -> DataFrame:
    """Files outside a removed subtree."""
    return files.join(folders_gone.select(F.col("folder_id").alias("parent_id")), "parent_id", "left_anti").select(files.columns)


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files moved by (file_id, parent_id, file_name); a live file in the place is overwritten."""
    m = moves.select("file_id", F.col("parent_id").alias("new_parent"), F.col("file_name").alias("new_name"), F.lit(True).alias("moved"))
    out = files.join(m, "file_id", "left").withColumns({"parent_id": F.when(F.col("moved"), F.col("new_parent")).otherwise(F.col("parent_id")), "file_name": F.when(F.col("moved"), F.col("new_name")).otherwise(F.col("file_name"))})
    w = Window.partitionBy("user_id", F.coalesce("parent_id", F.lit("")), "file_name").orderBy(F.coalesce("moved", F.lit(False)).desc(), F.desc("updated_at"), F.desc("file_id"))
    return out.withColumn("overwritten", F.row_number().over(w) > 1).drop("new_parent", "new_name", "moved")


def unlinked(versions: DataFrame, paths: DataFrame, now_ms: int, tombstone_id: str) -> DataFrame:
    """Histories with a tombstone for each path."""
    return versions.unionByName(paths.select("path_id", F.lit(tombstone_id).alias("version_id"), F.lit(now_ms).cast("long").alias("mtime_ms"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("deleted"), F.lit(False).alias("user_visible")))


def purged(table: DataFrame, paths: DataFrame, key: str = "path_id") -> DataFrame:
    """A table without the rows of paths; missing paths are no error."""
    return table.join(paths.select(key), key, "left_anti").select(table.columns)


def copied_tags(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tags with those of each source given to its copy."""
    new = tags.join(pairs, tags["path_id"] == pairs["source"]).select(F.col("copy").alias("path_id"), "tag")
    return insert_or_ignore(tags, new, ["path_id", "tag"])


def compare_and_set(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Head moves (file_id, expected, new) that apply only if the head is the expected one, null included."""
    c = commands.select("file_id", "expected", "new", F.lit(True).alias("asked"))
    ok = F.coalesce("asked", F.lit(False)) & F.col("head_version_id").eqNullSafe(F.col("expected"))
    return rows.join(c, "file_id", "left").select("file_id", F.when(ok, F.col("new")).otherwise(F.col("head_version_id")).alias("head_version_id"), F.when(F.col("asked"), ok).alias("patched"))


def orphaned_uploads(files: DataFrame, writes: DataFrame, uploads: DataFrame, now_ms: int, age_ms: int = 3_600_000) -> DataFrame:
    """Unfinished files that are old, and whose write or upload session is gone or has ended."""
    w = writes.select(F.col("tmp_id").alias("file_id"), F.col("expires_at").alias("w_until"))
    u = uploads.select(F.col("upload_id").alias("file_id"), F.col("expires_at").alias("u_until"))
    rows = files.where((F.col("status") == "uploading") & (F.col("updated_at") < now_ms - age_ms)).join(w, "file_id", "left").join(u, "file_id", "left")
    none = F.col("w_until").isNull() & F.col("u_until").isNull()
    return rows.where(none | (F.col("w_until") < now_ms) | (F.col("u_until") < now_ms)).select("file_id")


def next_deadline(*deadlines: DataFrame) -> DataFrame:
    """The least of the one-column tables of times."""
    first = deadlines[0].toDF("at")
    for d in deadlines[1:]:
        first = first.union(d.toDF("at"))
    return first.agg(F.min("at").alias("at"))


def made_folders(folders: DataFrame, files: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders after mkdir of (folder_id, parent_id, name), and each outcome: EEXIST where a folder or a live file has the place, ENOENT without the parent.

    Of several new folders of one place the least id is made, others are EEXIST.
    """
    place = [F.coalesce("parent_id", F.lit("")).alias("parent"), F.col("name")]
    taken = folders.select(*place).union(files.where("status <> 'deleted'").select(F.coalesce("parent_id", F.lit("")), "file_name")).distinct().withColumn("taken", F.lit(True))
    known = folders.select(F.col("folder_id").alias("parent"), F.lit(True).alias("known"))
    rows = asked.select("folder_id", "parent_id", *place)
    first = rows.groupBy("parent", "name").agg(F.min("folder_id").alias("first"))
    out = rows.join(taken, ["parent", "name"], "left").join(known, "parent", "left").join(first, ["parent", "name"])
    code = F.when((F.col("parent") != "") & F.col("known").isNull(), "ENOENT").when(F.col("taken") | (F.col("folder_id") != F.col("first")), "EEXIST").otherwise("OK")
    out = out.withColumn("code", code)
    return folders.unionByName(out.where("code = 'OK'").select("folder_id", "parent_id", "name"), allowMissingColumns=True), out.select("folder_id", "code")


def removed_folders(folders: DataFrame, files: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders after rmdir, and each outcome: ENOENT, or ENOTEMPTY with any folder or live file in it."""
    used = folders.select("parent_id").union(files.where("status <> 'deleted'").select("parent_id")).distinct().select(F.col("parent_id").alias("folder_id"), F.lit(True).alias("used"))
    there = folders.select("folder_id", F.lit(True).alias("there"))
    out = asked.select("folder_id").distinct().join(there, "folder_id", "left").join(used, "folder_id", "left")
    out = out.select("folder_id", F.when(F.col("there").isNull(), "ENOENT").when(F.col("used"), "ENOTEMPTY").otherwise("OK").alias("code"))
    return folders.join(out.where("code = 'OK'"), "folder_id", "left_anti"), out


def changed_modes(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Files with ``mode`` after chmod of (file_id, new_mode): EINVAL outside 0 to 0o7777, ENOENT without the file."""
    out = asked.join(files.select("file_id", F.col("mode").alias("old"), F.lit(True).alias("there")), "file_id", "left")
    code = F.when(F.col("there").isNull(), "ENOENT").when(~F.col("new_mode").between(0, 0o7777), "EINVAL").otherwise("OK")
    return out.select("file_id", F.when(code == "OK", F.col("new_mode")).otherwise(F.col("old")).alias("mode"), code.alias("code"))


def linked(files: DataFrame, asked: DataFrame, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (file_id, parent_id, file_name, status, link_target) after symlink, and each outcome: EINVAL without a target, EEXIST where a folder or live file has the place."""
    parent = F.coalesce("parent_id", F.lit("")).alias("parent")
    taken = files.where("status <> 'deleted'").select(parent, "file_name")
    if folders is not None:
        taken = taken.union(folders.select(parent, "name"))
    out = asked.withColumn("parent", parent).join(taken.distinct().withColumn("taken", F.lit(True)), ["parent", "file_name"], "left")
    out = out.withColumn("code", F.when(F.coalesce("link_target", F.lit("")) == "", "EINVAL").when(F.col("taken"), "EEXIST").otherwise("OK"))
    new = out.where("code = 'OK'").select("file_id", "parent_id", "file_name", F.lit("complete").alias("status"), "link_target")
    return files.unionByName(new, allowMissingColumns=True), out.select("file_id", "code")


def archived(files: DataFrame, versions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after (file_id, archive), and each outcome: ENOENT for missing and tombstoned ones."""
    from catalith.operators.listing import visible

    seen = visible(files.where("status <> 'deleted'"), versions).select("file_id", F.lit(True).alias("seen"))
    out = asked.join(seen, "file_id", "left").select("file_id", "archive", F.when(F.col("seen"), "OK").otherwise("ENOENT").alias("code"))
    done = out.where("code = 'OK'").select("file_id", F.col("archive").alias("__a"))
    return files.join(done, "file_id", "left").withColumn("archived", F.coalesce("__a", "archived")).drop("__a"), out.select("file_id", "code")


def edited_tags(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags after edits (path_id, replace, add, remove) of tag lists: ``replace`` (null: none) drops what was there, ``add`` comes before ``remove``."""
    whole = edits.where("replace is not null").select("path_id")
    kept = tags.join(whole, "path_id", "left_anti").select("path_id", "tag")
    new = edits.select("path_id", F.explode(F.array_union(F.coalesce("replace", F.array().cast("array<string>")), F.coalesce("add", F.array().cast("array<string>")))).alias("tag"))
    gone = edits.select("path_id", F.explode("remove").alias("tag"))
    return kept.union(new).distinct().join(gone, ["path_id", "tag"], "left_anti")


#: Bytes of a file's metadata, and tags of a file, at most (fixed values).
METADATA_BYTES, TAGS = 64 << 10, 32


def patched(files: DataFrame, tags: DataFrame, patches: DataFrame, merge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files' metadata and tags after patches (file_id, patch, expected, replace, add, remove), and each outcome.

    ``merge(metadata, patch)`` joins JSON texts.  A patch with an ``expected`` head
    applies only if that is the head.  ENOENT: no file; EINVAL: too large; STALE: another head.
    """
    now = files.select("file_id", "metadata", "head_version_id", F.lit(True).alias("there"))
    out = patches.join(now, "file_id", "left").withColumn("merged", merge(F.col("metadata"), F.col("patch")))
    stale = F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("head_version_id"))
    code = F.when(F.col("there").isNull(), "ENOENT").when(stale, "STALE").when(F.octet_length("merged") > METADATA_BYTES, "EINVAL").otherwise("OK")
    out = out.withColumn("code", code)
    good = out.where("code = 'OK'")
    after = files.join(good.select("file_id", F.col("merged").alias("__m"), F.lit(True).alias("__ok")), "file_id", "left")
    after = after.withColumn("metadata", F.when(F.col("__ok"), F.col("__m")).otherwise(F.col("metadata"))).drop("__m", "__ok")
    edits = good.select(F.col("file_id").alias("path_id"), "replace", "add", "remove")
    return after, edited_tags(tags, edits), out.select("file_id", "code", "head_version_id")


def copied(files: DataFrame, chunks: DataFrame, store: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (references) after copies (source, copy), and each outcome: ENOENT without the source, ENOCHUNK where one of its chunks is not alive.  Copies share hashes and have references of their own.

    References meet the store first, so that hashes move once, and only ids of files that lost a chunk after that.
    """
    from catalith.operators.chunks import alive

    live = alive(store).select("chunk_hash", F.lit(True).alias("live"))
    lost = chunks.join(live, "chunk_hash", "left_anti").select(F.col("file_id").alias("source")).distinct().withColumn("lost", F.lit(True))
    there = files.select(F.col("file_id").alias("source"), F.lit(True).alias("there"))
    out = pairs.join(there, "source", "left").join(lost, "source", "left")
    out = out.select("source", "copy", F.when(F.col("there").isNull(), "ENOENT").when(F.col("lost"), "ENOCHUNK").otherwise("OK").alias("code"))
    new = chunks.join(out.where("code = 'OK'").select(F.col("source").alias("file_id"), "copy"), "file_id").withColumn("file_id", F.col("copy")).select(chunks.columns)
    return chunks.unionByName(new), out


def wiped(tables: dict[str, tuple[DataFrame, str]], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of users (by each table's own column of users), and how many rows each lost."""
    left, counts = {}, None
    for name, (df, column) in tables.items():
        gone = users.select(F.col("user_id").alias(column)).distinct()
        left[name] = df.join(gone, column, "left_anti")
        n = df.join(gone, column, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.union(n)
    return left, counts


def soft_deleted(files: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Files with the asked ones' status deleted."""
    return files.join(asked.select("file_id", F.lit(True).alias("__gone")), "file_id", "left").withColumns({"status": F.when(F.col("__gone"), "deleted").otherwise(F.col("status")), "updated_at": F.when(F.col("__gone"), F.lit(now_ms).cast("long")).otherwise(F.col("updated_at"))}).drop("__gone")


def moved_folders(folders: DataFrame, files: DataFrame, moves: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders after moves (folder_id, parent_id, name), and each outcome.

    ENOENT: no such folder, or none to move into; EINVAL: into itself or below
    (``tops`` has (folder_id, above) for every folder and what is above it, itself
    included); EEXIST: a folder or live file has the place.
    """
    parent = F.coalesce("parent_id", F.lit("")).alias("parent")
    taken = folders.select(parent, "name", F.col("folder_id").alias("holder")).union(files.where("status <> 'deleted'").select(parent, F.col("file_name"), F.lit("")))
    taken = taken.groupBy("parent", "name").agg(F.max("holder").alias("holder"), F.lit(True).alias("taken"))
    there = folders.select("folder_id", F.lit(True).alias("there"))
    into = folders.select(F.col("folder_id").alias("parent"), F.lit(True).alias("known"))
    below = tops.select(F.col("folder_id").alias("parent"), F.col("above").alias("folder_id"), F.lit(True).alias("below")).distinct()
    out = moves.withColumn("parent", parent).join(there, "folder_id", "left").join(into, "parent", "left").join(below, ["parent", "folder_id"], "left").join(taken, ["parent", "name"], "left")
    lost = F.col("there").isNull() | ((F.col("parent") != "") & F.col("known").isNull())
    code = F.when(lost, "ENOENT").when(F.col("below"), "EINVAL").when(F.col("taken") & (F.col("holder") != F.col("folder_id")), "EEXIST").otherwise("OK")
    out = out.withColumn("code", code)
    done = out.where("code = 'OK'").select("folder_id", F.col("parent_id").alias("__p"), F.col("name").alias("__n"), F.lit(True).alias("__ok"))
    after = folders.join(done, "folder_id", "left").withColumns({"parent_id": F.when(F.col("__ok"), F.col("__p")).otherwise(F.col("parent_id")), "name": F.when(F.col("__ok"), F.col("__n")).otherwise(F.col("name"))})
    return after.drop("__p", "__n", "__ok"), out.select("folder_id", "code")


def removal(folders: DataFrame, files: DataFrame, versioned: DataFrame) -> DataFrame:
    """What a recursive remove of a subtree (folder_id, depth) does, in order: files first, tombstoned where their user keeps versions and else deleted, then folders, the deepest first."""
    keeps = versioned.select("user_id", F.lit(True).alias("keeps"))
    gone = files.where("status <> 'deleted'").join(folders.select(F.col("folder_id").alias("parent_id")), "parent_id", "left_semi").join(keeps, "user_id", "left")
    of_files = gone.select(F.lit(0).alias("step"), F.lit(0).alias("depth"), F.col("file_id").alias("id"), F.when(F.col("keeps"), "tombstone").otherwise("delete").alias("action"))
    return of_files.unionByName(folders.select(F.lit(1).alias("step"), (-F.col("depth")).alias("depth"), F.col("folder_id").alias("id"), F.lit("remove").alias("action")))


def carried_tags(tags: DataFrame, rows: DataFrame) -> DataFrame:
    """Tags after rows (user_id, parent_id, file_name, updated_at, file_id) are published: the live one of a place takes over those of the newest other one if it has none."""
    w = Window.partitionBy("user_id", F.coalesce("parent_id", F.lit("")), "file_name").orderBy(F.desc("updated_at"), F.desc("file_id"))
    placed = rows.withColumns({"place": F.row_number().over(w), "next": F.lead("file_id").over(w)})
    live = placed.where("place = 1").select(F.col("file_id").alias("path_id"), "next")
    bare = live.join(tags.select("path_id").distinct(), "path_id", "left_anti").where("next is not null")
    taken = bare.select("path_id", F.col("next").alias("other")).join(tags.select(F.col("path_id").alias("other"), "tag"), "other").select("path_id", "tag")
    own = tags.join(live.select("path_id"), "path_id", "left_semi").select("path_id", "tag")
    return own.union(taken).distinct()
