"""Queries over listings, reports and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.adapters import catalog, duckdb_with, source
from catalith.operators import history, listing, reporting

QUERIES, ORACLE_SQL = {}, {}
VISIBLE = "FROM files f LEFT JOIN file_versions v ON v.path_id = f.file_id AND v.version_id = f.head_version_id WHERE (f.head_version_id IS NULL OR v.deleted IS NULL OR NOT v.deleted)"
_PAGE = "SELECT f.file_id, f.file_name, f.user_id, coalesce(v.size, f.file_size) AS size, coalesce(v.mtime_ms, f.updated_at) AS mtime, f.mime_type, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM file_tags t WHERE t.path_id = f.file_id), '') AS tags"
_LIVE = " AND f.status = 'complete' AND NOT f.archived"


def query(sql: str | None = None, *tables: str):
    """Register a query, with SQL over catalog tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{duckdb_with(*tables)} {sql}" if tables else sql
        return f

    return add


def _three(spark, d):
    return catalog(spark, d, "files"), catalog(spark, d, "file_versions"), catalog(spark, d, "file_tags")


LISTED = ("files", "file_versions", "file_tags")


@query(f"{_PAGE} {VISIBLE}{_LIVE} AND EXISTS (SELECT 1 FROM file_tags t WHERE t.path_id = f.file_id AND tag = 'en') ORDER BY f.file_size DESC, f.file_id LIMIT 50", *LISTED)
def list_files_page(spark, d):
    return listing.list_files(*_three(spark, d), any_parent=True, wanted_tags=["en"], order="size")


@query(f"{_PAGE} {VISIBLE}{_LIVE} AND coalesce(f.parent_id, '') = '' ORDER BY f.updated_at DESC, f.file_id LIMIT 100", *LISTED)
def list_files_root(spark, d):
    return listing.list_files(*_three(spark, d), limit=100)


@query(f"{_PAGE} {VISIBLE}{_LIVE} AND (SELECT count(DISTINCT tag) FROM file_tags t WHERE t.path_id = f.file_id AND tag IN ('en', 'src3')) = 2 ORDER BY f.file_name, f.file_id LIMIT 1000", *LISTED)
def list_files_tags_and(spark, d):
    return listing.list_files(*_three(spark, d), any_parent=True, wanted_tags=["en", "src3"], order="name", limit=1000)


@query(f"{_PAGE} {VISIBLE}{_LIVE} AND (f.updated_at < 500000 OR (f.updated_at = 500000 AND f.file_id > '000000000100')) ORDER BY f.updated_at DESC, f.file_id LIMIT 50", *LISTED)
def list_files_keyset_next(spark, d):
    return listing.list_files(*_three(spark, d), any_parent=True, after_row=(500_000, "000000000100"))


@query("SELECT id, props FROM audit_log WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7", "audit_log")
def list_files_metadata(spark, d):
    log = catalog(spark, d, "audit_log")
    return log.where(listing.metadata_matches(F.col("props"), {"k": 7})).select("id", "props")


@query(f"""SELECT * FROM (SELECT 'folder' AS kind, folder_id AS id, name, 0::BIGINT AS size, 0 AS rank FROM folders WHERE coalesce(parent_id, '') = ''
    UNION ALL SELECT 'file', f.file_id, f.file_name, coalesce(v.size, f.file_size), 2 {VISIBLE}{_LIVE} AND coalesce(f.parent_id, '') = '') ORDER BY name, rank, id LIMIT 60""", *LISTED, "folders")
def list_children_merged(spark, d):
    files, versions, _ = _three(spark, d)
    return listing.list_children(catalog(spark, d, "folders"), files, versions, None, 60).select("kind", "id", "name", "size", "rank")


@query("SELECT name FROM folders WHERE coalesce(parent_id, '') = '' UNION SELECT file_name FROM files WHERE coalesce(parent_id, '') = '' AND status <> 'deleted'", "files", "folders")
def readdir(spark, d):
    return listing.readdir(catalog(spark, d, "folders"), catalog(spark, d, "files"), None)


@query(f"""SELECT pos, p.file_id, s.size, s.mime_type, CASE WHEN s.size IS NULL THEN 'ENOENT' END AS error_code
    FROM (SELECT i AS pos, CASE WHEN i % 7 = 0 THEN 'none' ELSE lpad(CAST(i * 3 % 500 AS VARCHAR), 12, '0') END AS file_id FROM range(200) t(i)) p
    LEFT JOIN (SELECT f.file_id, coalesce(v.size, f.file_size) AS size, f.mime_type {VISIBLE} AND f.status <> 'deleted') s ON s.file_id = p.file_id""", *LISTED)
def stat_many(spark, d):
    files, versions, _ = _three(spark, d)
    asked = spark.range(200).select(F.col("id").alias("pos"), F.when(F.col("id") % 7 == 0, "none").otherwise(F.lpad((F.col("id") * 3 % 500).cast("string"), 12, "0")).alias("file_id"))
    return listing.many(asked, files, versions)


@query(f"SELECT f.file_id, f.created_at, f.file_size % 7 AS attempts {VISIBLE} AND f.status = 'complete' AND f.file_size % 3 <> 0 AND f.file_size % 7 < 5 ORDER BY f.created_at, f.file_id LIMIT 100", *LISTED)
def unindexed_queue(spark, d):
    files, versions, _ = _three(spark, d)
    return listing.unindexed(files, versions, F.col("file_size") % 7, F.when(F.col("file_size") % 3 == 0, F.lit(1).cast("long")), 500)


@query("SELECT file_id, file_name, mime_type FROM files WHERE status <> 'deleted' AND mime_type LIKE 'image/%' AND mime_type NOT LIKE '%gif%'", "files")
def gallery_photos(spark, d):
    return listing.photos(catalog(spark, d, "files")).select("file_id", "file_name", "mime_type")


@query("SELECT file_id FROM files WHERE mime_type = 'image/png' AND file_size <= 2000", "files")
def image_indexable(spark, d):
    return listing.index_by_image(catalog(spark, d, "files"), 2000).select("file_id")


@query("SELECT file_id, file_name FROM files WHERE file_name ILIKE 'DOC_1_._xt'", "files")
def like_wildcards(spark, d):
    files = catalog(spark, d, "files")
    return files.where(F.col("file_name").ilike("DOC_1_._xt")).select("file_id", "file_name")


@query("SELECT count(*) FILTER (status = 'uploading') AS uploading, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed FROM files", "files")
def stats_by_status(spark, d):
    return reporting.by_status(catalog(spark, d, "files"))


@query("SELECT mime_type, count(*) AS n, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM files GROUP BY 1", "files")
def stats_by_mime(spark, d):
    return reporting.by_mime(catalog(spark, d, "files"))


@query("SELECT shard_index, count(*) AS chunks, sum(chunk_size)::BIGINT AS bytes FROM file_chunks WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1", "file_chunks")
def shard_distribution(spark, d):
    live = source(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"))
    return reporting.shard_distribution(catalog(spark, d, "file_chunks"), live)


_STORE = "s AS (SELECT shard_index, chunk_hash, max(chunk_size) AS size, count(*) AS ref_count, max(chunk_size) % 5 = 0 AS deleted FROM file_chunks GROUP BY 1, 2)"


def _store(spark, d):
    return reporting.store(catalog(spark, d, "file_chunks"), F.col("size") % 5 == 0)


@query(f""", {_STORE}, e AS (SELECT shard_index::BIGINT AS shard_index, count(*) AS chunks, sum(size)::BIGINT AS bytes, sum(ref_count)::BIGINT AS refs FROM s GROUP BY 1),
    a AS (SELECT * FROM e UNION ALL SELECT -1, sum(chunks)::BIGINT, sum(bytes)::BIGINT, sum(refs)::BIGINT FROM e)
    SELECT *, CASE WHEN refs > 0 THEN floor((1 - chunks / refs) * 10000 + 0.5) / 10000 ELSE 0 END AS ratio FROM a""", "file_chunks")
def dedup_ratio(spark, d):
    return reporting.dedup(_store(spark, d))


@query(f", {_STORE} SELECT count(*) AS chunks, coalesce(sum(size), 0)::BIGINT AS bytes FROM s WHERE NOT deleted", "file_chunks")
def chunk_bytes_live(spark, d):
    return reporting.live_bytes(_store(spark, d))


@query("SELECT file_id, file_name, status, created_at FROM files ORDER BY created_at DESC, file_id LIMIT 10", "files")
def recent_top10(spark, d):
    return reporting.recent(catalog(spark, d, "files"))


@query("""SELECT user_id, bytes, floor(100.0::DOUBLE * bytes / sum(bytes) OVER () * 100 + 0.5) / 100 AS share, floor(100.0::DOUBLE * bytes / max(bytes) OVER () * 100 + 0.5) / 100 AS height,
    floor(100.0::DOUBLE * bytes / 107374182400 * 1000000 + 0.5) / 1000000 AS quota FROM (SELECT user_id, sum(file_size)::BIGINT AS bytes FROM files GROUP BY 1)""", "files")
def quota_shares(spark, d):
    return reporting.shares(catalog(spark, d, "files"))


@query("SELECT file_hash, file_size, count(*) AS n FROM files GROUP BY 1, 2 HAVING count(*) > 1", "files")
def duplicate_contents(spark, d):
    return reporting.duplicates(catalog(spark, d, "files"), "file_hash", "file_size")


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN age = 0 THEN 'Today' WHEN age = 1 THEN 'Yesterday' WHEN age > 1 AND age < 7 THEN strftime(day, '%A')
    WHEN year(day) = 2024 THEN strftime(day, '%B %-d') ELSE strftime(day, '%B %-d, %Y') END AS label, n
    FROM (SELECT CAST(make_timestamp(ts * 1000) AS DATE) AS day, date_diff('day', CAST(make_timestamp(ts * 1000) AS DATE), DATE '2024-01-20') AS age, count(*) AS n FROM audit_log GROUP BY 1, 2)""", "audit_log")
def date_groups(spark, d):
    return reporting.date_groups(catalog(spark, d, "audit_log"), "ts", 1_705_708_800_000)


@query("""SELECT path_id, len(v) AS n, v[least(len(v), CAST(floor(0.95 * len(v)) AS INT) + 1)] AS q FROM (SELECT path_id, list_sort(list(value)) AS v
    FROM (SELECT path_id, value, row_number() OVER (PARTITION BY path_id ORDER BY seq DESC) AS rn FROM audit_log) WHERE rn <= 32 GROUP BY 1)""", "audit_log")
def quantile_ring(spark, d):
    return reporting.nearest_rank(catalog(spark, d, "audit_log"), "path_id", "seq", "value", 0.95)


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY mtime_ms DESC, version_id DESC) AS place FROM versions_history)"


@query(f", {_RANKED} SELECT path_id, version_id, mtime_ms, size, deleted FROM r WHERE place = 1", "versions_history")
def head_versions(spark, d):
    return history.heads(catalog(spark, d, "versions_history"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY mtime_ms DESC, version_id DESC) AS place FROM versions_history WHERE NOT deleted) SELECT path_id, version_id, mtime_ms, size, deleted FROM r WHERE place = 1", "versions_history")
def latest_live(spark, d):
    return history.latest_live(catalog(spark, d, "versions_history"))


@query("SELECT path_id, version_id, mtime_ms, size, row_number() OVER (PARTITION BY path_id ORDER BY mtime_ms DESC, version_id DESC) AS place FROM versions_history WHERE user_visible", "versions_history")
def list_versions(spark, d):
    return history.list_versions(catalog(spark, d, "versions_history"), True).select("path_id", "version_id", "mtime_ms", "size", "place")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY mtime_ms DESC, version_id DESC) AS place FROM versions_history WHERE mtime_ms <= 2000) SELECT path_id, version_id, mtime_ms, size, deleted FROM r WHERE place = 1 AND NOT deleted", "versions_history")
def as_of_version(spark, d):
    return history.as_of(catalog(spark, d, "versions_history"), 2000)


#: Pointers: none for a quarter of the paths, an old version for another, else the newest; 000000 is kept, two versions are, and those from 4000 ms on.
_POINTERS = "h AS (SELECT path_id, CASE CAST(substr(path_id, 2) AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '000001' ELSE arg_max(version_id, (mtime_ms, version_id)) END AS head FROM versions_history GROUP BY 1)"
_DROPPED = f"""{_POINTERS}, k AS (SELECT v.*, head, coalesce(version_id = head, false) OR version_id = '000000' AS safe FROM versions_history v JOIN h USING (path_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY path_id, safe ORDER BY mtime_ms DESC, version_id DESC) AS place FROM k),
    x AS (SELECT * FROM q WHERE NOT safe AND place > CASE WHEN head IS NULL THEN 2 ELSE 1 END AND mtime_ms < 4000)"""


def _pointers(v):
    n = F.substring("path_id", 2, 30).cast("long") % 4
    newest = F.max_by("version_id", F.struct("mtime_ms", "version_id"))
    return v.groupBy("path_id").agg(newest.alias("newest")).select("path_id", F.when(n == 1, "000001").when(n > 1, F.col("newest")).alias("head_version_id"))


def _dropped(v):
    return history.dropped(v, _pointers(v), 4000, 2, ["000000"])


@query(f", {_DROPPED} SELECT path_id, version_id, mtime_ms, size FROM x", "versions_history")
def drop_versions_policy(spark, d):
    return _dropped(catalog(spark, d, "versions_history")).select("path_id", "version_id", "mtime_ms", "size")


@query(f", {_DROPPED} SELECT path_id, count(*) AS n, sum(CASE WHEN NOT deleted THEN size ELSE 0 END)::BIGINT AS bytes FROM x GROUP BY 1", "versions_history")
def reclaimed_bytes(spark, d):
    v = catalog(spark, d, "versions_history")
    return history.reclaimed(v, _dropped(v))


@query("""SELECT path_id, CASE WHEN max(version_id = '000002') THEN '000002' ELSE arg_max(version_id, (mtime_ms, version_id)) END AS head_version_id
    FROM versions_history WHERE mtime_ms < 4000 GROUP BY 1""".replace("max(version_id = '000002')", "bool_or(version_id = '000002')"), "versions_history")
def repair_heads(spark, d):
    v = catalog(spark, d, "versions_history")
    pointers = v.select("path_id").distinct().withColumn("head_version_id", F.lit("000002"))
    return history.repaired_heads(pointers, v.where("mtime_ms < 4000"))


@query(f""", {_RANKED}, l AS (SELECT path_id, arg_max(version_id, (mtime_ms, version_id)) AS walk_back FROM versions_history WHERE NOT deleted GROUP BY 1)
    SELECT path_id, version_id AS tombstone, walk_back FROM r LEFT JOIN l USING (path_id) WHERE place = 1 AND deleted""", "versions_history")
def reap_tombstones(spark, d):
    return history.tombstoned(catalog(spark, d, "versions_history"))


@query("""SELECT path_id, version_id, mtime_ms, size, deleted, user_visible FROM versions_history
    UNION ALL SELECT path_id, 'restored', 99000, size, false, false FROM versions_history WHERE version_id = '000001' AND NOT deleted""", "versions_history")
def restore_version(spark, d):
    v = catalog(spark, d, "versions_history")
    return history.restored(v, v.where("version_id = '000001'").select("path_id", "version_id"), 99_000, "restored")[0]


@query("""SELECT p.path_id, '000001' AS version_id, CASE WHEN v.path_id IS NULL THEN 'ENOENT' WHEN v.deleted THEN 'EINVAL' WHEN v.size % 5 = 0 THEN 'ENOCHUNK' ELSE 'OK' END AS code
    FROM (SELECT DISTINCT path_id FROM versions_history) p LEFT JOIN versions_history v ON v.path_id = p.path_id AND v.version_id = '000001'""", "versions_history")
def restore_outcome(spark, d):
    v = catalog(spark, d, "versions_history")
    asked = v.select("path_id").distinct().withColumn("version_id", F.lit("000001"))
    return history.restored(v, asked, 99_000, "restored", v.where("size % 5 <> 0").select("path_id", "version_id"))[1]


@query("""SELECT p.path_id, p.version_id, CASE WHEN NOT v.deleted THEN v.version_id END AS found, CASE WHEN NOT v.deleted THEN v.size END AS size, CASE WHEN v.path_id IS NULL OR v.deleted THEN 'ENOENT' END AS error_code
    FROM (SELECT DISTINCT path_id, '000002' AS version_id FROM versions_history) p LEFT JOIN versions_history v ON v.path_id = p.path_id AND v.version_id = '000002'
    UNION ALL SELECT p.path_id, NULL, v.version_id, v.size, CASE WHEN v.path_id IS NULL THEN 'ENOENT' END FROM (SELECT DISTINCT path_id FROM versions_history) p
    LEFT JOIN (SELECT path_id, arg_max(version_id, (mtime_ms, version_id)) AS version_id, arg_max(size, (mtime_ms, version_id)) AS size FROM versions_history WHERE NOT deleted GROUP BY 1) v USING (path_id)""", "versions_history")
def get_version(spark, d):
    v = catalog(spark, d, "versions_history")
    paths = v.select("path_id").distinct()
    asked = paths.withColumn("version_id", F.lit("000002")).union(paths.withColumn("version_id", F.lit(None).cast("string")))
    return history.version_of(v, asked).select("path_id", "version_id", "found", "size", "error_code")


@query("""SELECT path_id, version_id, user_visible OR coalesce(turn_mark = 1, false) AS user_visible, CASE WHEN turn_mark IS NOT NULL AND turn_mark <> 2 THEN 'kept' END AS label
    FROM (SELECT *, CASE WHEN CAST(version_id AS BIGINT) % 5 IN (1, 2, 3) THEN CAST(version_id AS BIGINT) % 5 END AS turn_mark FROM versions_history)""", "versions_history")
def mark_versions(spark, d):
    """Versions 1, 2 and 3 of five are marked: visible and labelled, neither, and labelled only."""
    v = catalog(spark, d, "versions_history").withColumn("label", F.lit(None).cast("string"))
    n = F.col("version_id").cast("long") % 5
    marks = v.where(n.isin(1, 2, 3)).select("path_id", "version_id", (n == 1).alias("visible"), F.when(n != 2, "kept").alias("label"))
    return history.marked(v, marks).select("path_id", "version_id", "user_visible", "label")


@query(f""", {_POINTERS}, n AS (SELECT path_id, head, CAST(substr(path_id, 2) AS BIGINT) AS i FROM h), w AS (SELECT n.*, coalesce(v.deleted, true) AS was FROM n LEFT JOIN versions_history v ON v.path_id = n.path_id AND v.version_id = n.head),
    c AS (SELECT *, i % 3 = 2 AS gone, i % 5 <> 0 OR head IS NOT DISTINCT FROM '000001' AS ok FROM w)
    SELECT path_id, CASE WHEN ok THEN 'new' ELSE head END AS head_version_id, ok AS committed, CASE WHEN ok AND NOT gone THEN i * 10 ELSE 0 END AS bytes_added, CASE WHEN ok THEN was::INT - gone::INT ELSE 0 END AS files_added FROM c""", "versions_history")
def commit_versions(spark, d):
    """A commit for each path, a tombstone for every third; every fifth is checked against an expected head."""
    v = catalog(spark, d, "versions_history")
    n = F.substring("path_id", 2, 30).cast("long")
    new = v.select("path_id").distinct().select("path_id", F.lit("new").alias("version_id"), F.lit(88_000).cast("long").alias("mtime_ms"), (n * 10).alias("size"), (n % 3 == 2).alias("deleted"), F.lit(True).alias("user_visible"), F.when(n % 5 == 0, "000001").alias("expected"))
    return history.committed(v, _pointers(v), new)[1]


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, id DESC) AS place, count(*) OVER (PARTITION BY actor) AS total FROM audit_log) SELECT id, actor, ts FROM r WHERE total <= 70 OR place <= 60", "audit_log")
def audit_retention(spark, d):
    return history.audit_kept(catalog(spark, d, "audit_log"), 70, 60).select("id", "actor", "ts")
