"""Listings: visibility, filters, keyset pages, children of a folder, hydration."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER_COLUMNS = {"mtime": ("updated_at", "desc"), "name": ("file_name", "asc"), "size": ("file_size", "desc")}
#: A folder sorts before a link, a link before a file (fixed values).
KIND_RANK = {"folder": 0, "symlink": 1, "file": 2}


class CatalogError(ValueError):
    """An invalid argument, with the code of its kind."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def same_parent(column: Column, parent: str | None) -> Column:
    """Root is null or empty; both are one place."""
    return F.coalesce(column, F.lit("")) == F.lit(parent or "")


def with_head(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files with the columns ``head_*`` of their head version; null where there is none, dangling pointers included."""
    v = versions.select(F.col("path_id").alias("head_path"), F.col("version_id").alias("head_id"), F.col("deleted").alias("head_deleted"), F.col("size").alias("head_size"), F.col("mtime_ms").alias("head_mtime"))
    return files.join(v, (F.col("file_id") == F.col("head_path")) & (F.col("head_version_id") == F.col("head_id")), "left").drop("head_path", "head_id")


def visible(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files that are not tombstoned: without a head, with a dangling one, or with a live one."""
    return with_head(files, versions).where(F.col("head_version_id").isNull() | F.col("head_deleted").isNull() | ~F.col("head_deleted"))


def with_all_tags(files: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Files that have every tag: one semi-join over tags counted per file, whatever their number."""
    if not wanted:
        return files
    distinct = sorted(set(wanted))
    hits = tags.where(F.col("tag").isin(distinct)).groupBy("path_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(distinct))
    return files.join(hits.select(F.col("path_id").alias("file_id")), "file_id", "left_semi")


def _key(name: str) -> str:
    """A step of a path into JSON, whatever the key's characters; paths know no escapes, so that a key may have one kind of quote only."""
    if "'" not in name:
        return f"['{name}']"
    if '"' not in name:
        return f'["{name}"]'
    raise CatalogError("EINVAL", "a metadata key may not have both kinds of quotes")


def metadata_matches(column: Column, wanted: dict) -> Column:
    """Whether JSON text contains the filter: objects recursively, arrays exactly and in order, scalars of the same type."""

    def leaf(path: str, value) -> Column:
        v = F.try_parse_json(column)
        at = F.try_variant_get(v, path, "variant")
        kind = F.schema_of_variant(at)
        if isinstance(value, dict):
            inner = [leaf(path + _key(k), x) for k, x in value.items()]
            return reduce(lambda a, b: a & b, inner, kind.startswith("OBJECT"))
        if isinstance(value, list):
            if any(isinstance(x, (dict, list)) for x in value):
                return F.lit(False)
            items = [leaf(f"{path}[{k}]", x) for k, x in enumerate(value)]
            size = F.size(F.try_variant_get(v, path, "array<variant>")) == len(value)
            return reduce(lambda a, b: a & b, items, kind.startswith("ARRAY") & size)
        if value is None:
            return kind == "VOID"
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == value)
        if isinstance(value, (int, float)):
            return (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(v, path, "double") == float(value))
        return (kind == "STRING") & (F.try_variant_get(v, path, "string") == value)

    return F.coalesce(reduce(lambda a, b: a & b, [leaf("$" + _key(k), x) for k, x in wanted.items()], F.lit(True)), F.lit(False))


def limit_of(limit: int | None) -> int:
    limit = 50 if limit is None else limit
    if not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise CatalogError("EINVAL", "limit must be 1 to 1000")
    return limit


def encode_cursor(secret: bytes, order: str, direction: str, value, file_id: str, kind: str | None = None) -> str:
    """An opaque signed cursor: the place of the last row of a page in its order."""
    body = json.dumps({"v": 1, "ob": order, "d": direction, "ov": value, "pid": file_id} | ({"k": kind} if kind else {}), separators=(",", ":")).encode()
    sign = base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest()).decode()[:22]
    return f"{base64.urlsafe_b64encode(body).decode().rstrip('=')}.{sign}"


def decode_cursor(secret: bytes, cursor: str, order: str, direction: str) -> dict:
    try:
        text, sign = cursor.split(".")
        body = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError as e:
        raise CatalogError("EINVAL", "malformed cursor") from e
    if not hmac.compare_digest(sign, base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest()).decode()[:22]):
        raise CatalogError("EINVAL", "cursor was changed")
    found = json.loads(body)
    if (found.get("v"), found.get("ob"), found.get("d")) != (1, order, direction):
        raise CatalogError("EINVAL", "cursor is of another order")
    return found


def after(order_value: Column, ids: Column, direction: str, value, last_id: str) -> Column:
    """Rows after a place in an order whose ties go by id, ascending in both directions."""
    beyond = order_value < F.lit(value) if direction == "desc" else order_value > F.lit(value)
    return beyond | ((order_value == F.lit(value)) & (ids > F.lit(last_id)))


def list_files(
    files: DataFrame, versions: DataFrame, tags: DataFrame, parent: str | None = None, any_parent: bool = False, wanted_tags: list[str] | None = None, order: str = "mtime", direction: str | None = None, limit: int | None = None,
    include_archived: bool = False, after_row: tuple | None = None, metadata: tuple[str, dict] | None = None, cursor: str | None = None, secret: bytes = b"", include: tuple[str, ...] = (), paths: DataFrame | None = None,
) -> DataFrame:
    """One exact page of visible, complete files, hydrated with sorted tags and head size.

    ``metadata`` is a column of JSON text and a filter on it; ``cursor`` is where
    a page before ended, signed with ``secret``; ``include`` names more columns
    (stat, hash, head, and path by the folders' ``paths``).  The page, at most a
    thousand rows, is taken first and held by the driver; tags and paths are then
    scanned once against it.
    """
    column, default = ORDER_COLUMNS[order]
    direction = direction or default
    if cursor:
        found = decode_cursor(secret, cursor, order, direction)
        after_row = (found["ov"], found["pid"])
    rows = files.where(F.col("status") == "complete")
    if not include_archived:
        rows = rows.where(~F.col("archived"))
    if not any_parent:
        rows = rows.where(same_parent(F.col("parent_id"), parent))
    if after_row:
        rows = rows.where(after(F.col(column), F.col("file_id"), direction, *after_row))
    if metadata:
        rows = rows.where(metadata_matches(F.col(metadata[0]), metadata[1]))
    needed = {"file_id", "file_name", "user_id", "file_size", "updated_at", "mime_type", "head_version_id", column}
    needed |= {"file_hash"} if "hash" in include else set()
    needed |= {"parent_id"} if "path" in include else set()
    needed |= {"status", "created_at"} if "stat" in include else set()
    rows = with_all_tags(visible(rows.select(*sorted(needed)), versions), tags, wanted_tags or [])
    by = F.col(column).desc() if direction == "desc" else F.col(column).asc()
    page = rows.orderBy(by, F.col("file_id").asc()).limit(limit_of(limit))
    page = page.sparkSession.createDataFrame(page.toArrow(), page.schema)
    asked = F.broadcast(page.select(F.col("file_id").alias("path_id")))
    own = tags.join(asked, "path_id", "left_semi").groupBy(F.col("path_id").alias("file_id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    out = page.join(own, "file_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))
    more = []
    if "stat" in include:
        more += ["status", "created_at"]
    if "hash" in include:
        more += ["file_hash"]
    if "head" in include:
        more += ["head_version_id"]
    if "path" in include:
        asked = F.broadcast(page.select("parent_id").distinct())
        folders = paths.select(F.col("folder_id").alias("parent_id"), F.col("path").alias("folder_path")).join(asked, "parent_id", "left_semi")
        out = out.join(folders, "parent_id", "left").withColumn("path", F.concat(F.coalesce("folder_path", F.lit("")), F.lit("/"), "file_name"))
        more += ["path"]
    out = out.coalesce(1).sortWithinPartitions(by, F.col("file_id").asc())  # a page
    return out.select("file_id", "file_name", "user_id", F.coalesce("head_size", "file_size").alias("size"), F.coalesce("head_mtime", "updated_at").alias("mtime"), "mime_type", "tags", *more)


def next_cursor(page: DataFrame, secret: bytes, order: str, direction: str | None, limit: int | None, values: DataFrame) -> str | None:
    """Where the next page of ``list_files`` begins: None after a page that is not full.  ``values`` are the files, for the value that the last row is ordered by."""
    column, default = ORDER_COLUMNS[order]
    rows = page.select("file_id").collect()  # a page, at most a thousand rows
    if len(rows) < limit_of(limit):
        return None
    last = rows[-1]["file_id"]
    return encode_cursor(secret, order, direction or default, values.where(F.col("file_id") == last).first()[column], last)


CHILD_ORDERS = {"name": ("name", "asc"), "mtime": ("mtime", "desc"), "size": ("size", "desc")}


def list_children(folders: DataFrame, files: DataFrame, versions: DataFrame, parent: str | None, limit: int | None = None, order: str = "name", direction: str | None = None, after_row: tuple | None = None) -> DataFrame:
    """Folders, links and files of a folder in one order, then by kind and id; ``has_more`` tells whether more follow the page.

    A folder has no size and counts as 0, and its ``updated_at`` is its time, 0
    without one.  A link's size is its target's bytes.  ``after_row`` is the value,
    kind and id that the page before ended with: one seek for all kinds.
    """
    n = limit_of(limit)
    column, default = CHILD_ORDERS[order]
    direction = direction or default
    zero = F.lit(0).cast("long")
    time = F.col("updated_at").cast("long") if "updated_at" in folders.columns else zero
    f = folders.where(same_parent(F.col("parent_id"), parent)).select(F.lit("folder").alias("kind"), F.col("folder_id").alias("id"), "name", zero.alias("size"), time.alias("mtime"))
    rows = visible(files.where(same_parent(F.col("parent_id"), parent) & (F.col("status") == "complete") & ~F.col("archived")), versions)
    linked = F.col("mime_type") == "inode/symlink"
    target = F.octet_length("link_target") if "link_target" in files.columns else F.lit(None).cast("long")
    size = F.when(linked, F.coalesce(target, "file_size")).otherwise(F.coalesce("head_size", "file_size")).cast("long")
    g = rows.select(F.when(linked, "symlink").otherwise("file").alias("kind"), F.col("file_id").alias("id"), F.col("file_name").alias("name"), size.alias("size"), F.coalesce("head_mtime", "updated_at").alias("mtime"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv)), F.col("kind"))
    every = f.unionByName(g).withColumn("rank", rank)
    if after_row:
        value, kind, last = after_row
        beyond = F.col(column) < F.lit(value) if direction == "desc" else F.col(column) > F.lit(value)
        every = every.where(beyond | ((F.col(column) == F.lit(value)) & ((F.col("rank") > KIND_RANK[kind]) | ((F.col("rank") == KIND_RANK[kind]) & (F.col("id") > F.lit(last))))))
    by = (F.col(column).desc() if direction == "desc" else F.col(column).asc(), F.col("rank").asc(), F.col("id").asc())
    probe = every.orderBy(*by).limit(n + 1)
    return probe.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > n).orderBy(*by).limit(n)  # a page, at most a thousand rows and one


def readdir(folders: DataFrame, files: DataFrame, parent: str | None) -> DataFrame:
    """Distinct names in a folder; tombstoned and unfinished files count."""
    a = folders.where(same_parent(F.col("parent_id"), parent)).select("name")
    b = files.where(same_parent(F.col("parent_id"), parent) & (F.col("status") != "deleted")).select(F.col("file_name").alias("name"))
    return a.union(b).distinct()


def many(paths: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """For (pos, file_id) rows: stat of each visible file, or the code ENOENT; order and repeats are kept by ``pos``."""
    found = visible(files.where(F.col("status") != "deleted"), versions).select("file_id", F.coalesce("head_size", "file_size").alias("size"), "mime_type")
    out = paths.join(found, "file_id", "left")
    return out.select("pos", "file_id", "size", "mime_type", F.when(F.col("size").isNull(), "ENOENT").alias("error_code"))


def unindexed(files: DataFrame, versions: DataFrame, attempts: Column, indexed_at: Column, limit: int = 25, most: int = 5) -> DataFrame:
    """Files to index next: complete, visible, not indexed, with attempts left; the oldest first."""
    rows = files.withColumns({"attempts": attempts, "indexed_at": indexed_at})
    rows = rows.where((F.col("status") == "complete") & F.col("indexed_at").isNull() & (F.col("attempts") < most))
    return visible(rows, versions).orderBy("created_at", "file_id").limit(max(1, min(100, limit))).select("file_id", "created_at", "attempts")


def marked(rows: DataFrame, most: int = 5) -> DataFrame:
    """A failed attempt is counted; ``capped`` tells that it was the last one allowed."""
    return rows.withColumn("capped", (F.col("attempts") < most) & (F.col("attempts") + 1 >= most)).withColumn("attempts", F.col("attempts") + 1)


def photos(files: DataFrame) -> DataFrame:
    """Images but animations, whatever the case of their type."""
    return files.where((F.col("status") != "deleted") & F.col("mime_type").ilike("image/%") & ~F.col("mime_type").ilike("%gif%"))


def index_by_image(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Files that an image model can read."""
    kinds = [f"image/{x}" for x in ("jpeg", "png", "gif", "webp", "bmp", "tiff", "avif")]
    return files.where(F.col("mime_type").isin(kinds) & (F.col("file_size") <= most_bytes))


def shared_album(files: DataFrame) -> DataFrame:
    """What visitors of a shared album see: complete images."""
    return files.where((F.col("status") == "complete") & F.col("mime_type").ilike("image/%"))


def best_variant(files: DataFrame, variants: DataFrame, wanted: list[str]) -> DataFrame:
    """Files with the first of the wanted variants (file_id, variant) that they have."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("variant"))
    best = variants.where(place > 0).groupBy("file_id").agg(F.min_by("variant", place).alias("variant"))
    return files.join(best, "file_id", "left")


def as_map(rows: DataFrame, ident: str) -> DataFrame:
    """Rows (id, key, value), each key once, as one map an id."""
    return rows.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def gated(rows: DataFrame, schemas: DataFrame, needed: int) -> DataFrame:
    """All rows if the newest of the schemas (version) is new enough, else none."""
    return rows.where(schemas.agg(F.max("version")).scalar() >= needed)


#: The bit of a file's mode that tells of shared editing (fixed value).
SHARED_EDITING = 0o4000


def api_rows(files: DataFrame) -> DataFrame:
    """Files with the names of the API, and the mode with its bit of shared editing."""
    mode = F.when(F.col("shared"), F.col("mode").bitwiseOR(SHARED_EDITING)).otherwise(F.col("mode"))
    names = {"file_id": "fileId", "file_name": "fileName", "file_size": "fileSize", "mime_type": "mimeType", "updated_at": "updatedAt"}
    return files.select(*names, mode.alias("mode")).withColumnsRenamed(names)


def file_info(nodes: DataFrame, files: DataFrame, versions: DataFrame, tags: DataFrame) -> DataFrame:
    """For (pos, node) of resolved files: stat, head, hash and tags of what is visible; ENOENT otherwise."""
    seen = visible(files.where(F.col("status") != "deleted"), versions).select(F.col("file_id").alias("node"), F.coalesce("head_size", "file_size").alias("size"), F.coalesce("head_mtime", "updated_at").alias("mtime"), "mime_type", "head_version_id", "file_hash")
    own = tags.join(nodes.select(F.col("node").alias("path_id")).distinct(), "path_id", "left_semi").groupBy(F.col("path_id").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    out = nodes.join(seen, "node", "left").join(own, "node", "left")
    code = F.when(F.col("mime_type").isNull(), "ENOENT")
    return out.select("pos", "node", "size", "mtime", "mime_type", "head_version_id", "file_hash", F.when(code.isNull(), F.coalesce("tags", F.lit(""))).alias("tags"), code.alias("error_code"))
