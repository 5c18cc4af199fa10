"""Queries of single requests and administration: paths, reads, folders, copies, tags, uploads, logs, variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalith.adapters import catalog, duckdb_with, source
from catalith.functions import arrow, scalars
from catalith.operators import chunks, folds, history, listing, mutations, reporting, resolve, tree
from catalith.plans.engine import packed_chunks, texted
from catalith.scratch import scratch_path
from catalith.sources import exported, read_files

QUERIES, ORACLE_SQL = {}, {}
VISIBLE = "FROM files f LEFT JOIN file_versions v ON v.path_id = f.file_id AND v.version_id = f.head_version_id WHERE (f.head_version_id IS NULL OR v.deleted IS NULL OR NOT v.deleted)"


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{duckdb_with(*tables)} {sql}" if tables else sql
        return f

    return add


# Listings in every order, with cursors, filters and more columns.

_TAGS = "coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM file_tags t WHERE t.path_id = f.file_id), '') AS tags"
_PAGE = f"SELECT f.file_id, f.file_name, f.user_id, coalesce(v.size, f.file_size) AS size, coalesce(v.mtime_ms, f.updated_at) AS mtime, f.mime_type, {_TAGS}"
_LIVE = " AND f.status = 'complete' AND NOT f.archived"
_SECRET = b"cursor secret"
LISTED = ("files", "file_versions", "file_tags")


def _three(spark, d):
    return catalog(spark, d, "files"), catalog(spark, d, "file_versions"), catalog(spark, d, "file_tags")


def _ordered(name: str, column: str, direction: str) -> None:
    sql = f"{_PAGE} {VISIBLE}{_LIVE} ORDER BY f.{column} {direction}, f.file_id LIMIT 200"

    def run(spark, d):
        return listing.list_files(*_three(spark, d), any_parent=True, order=name, direction=direction, limit=200)

    QUERIES[f"list_files_{name}_{direction}"] = run
    ORACLE_SQL[f"list_files_{name}_{direction}"] = f"{duckdb_with(*LISTED)} {sql}"


for _n, _c in (("mtime", "updated_at"), ("name", "file_name"), ("size", "file_size")):
    for _d in ("asc", "desc"):
        _ordered(_n, _c, _d)


@query(f"{_PAGE} {VISIBLE}{_LIVE} ORDER BY f.file_name, f.file_id LIMIT 40 OFFSET 40", *LISTED)
def list_files_cursor(spark, d):
    """The second page, by the cursor text that the first one ends with."""
    f, v, t = _three(spark, d)
    first = listing.list_files(f, v, t, any_parent=True, order="name", limit=40)
    cursor = listing.next_cursor(first, _SECRET, "name", None, 40, f)
    return listing.list_files(f, v, t, any_parent=True, order="name", limit=40, cursor=cursor, secret=_SECRET)


@query(f"""{_PAGE}, f.status, f.created_at, f.file_hash, f.head_version_id, '/' || f.file_name AS path {VISIBLE}{_LIVE} AND coalesce(f.parent_id, '') = '' AND length(f.file_name) = 11 ORDER BY f.file_size DESC, f.file_id LIMIT 100""", *LISTED)
def list_files_everything(spark, d):
    """A metadata filter and all optional columns in one listing."""
    f, v, t = _three(spark, d)
    f = f.withColumn("metadata", F.to_json(F.struct(F.struct(F.length("file_name").alias("a.b")).alias("it's"))))
    paths = tree.absolute_paths(catalog(spark, d, "folders"))
    return listing.list_files(f, v, t, order="size", limit=100, metadata=("metadata", {"it's": {"a.b": 11}}), include=("stat", "hash", "head", "path"), paths=paths)


_CHILDREN = f"""c AS (SELECT 'folder' AS kind, folder_id AS id, name, 0::BIGINT AS size, 0::BIGINT AS mtime, 0 AS rank FROM folders WHERE coalesce(parent_id, '') = ''
    UNION ALL SELECT CASE WHEN f.mime_type = 'text/fr' THEN 'symlink' ELSE 'file' END, f.file_id, f.file_name, CASE WHEN f.mime_type = 'text/fr' THEN strlen(f.file_hash) ELSE coalesce(v.size, f.file_size) END, coalesce(v.mtime_ms, f.updated_at),
    CASE WHEN f.mime_type = 'text/fr' THEN 1 ELSE 2 END {VISIBLE}{_LIVE} AND coalesce(f.parent_id, '') = '')"""


def _children(name: str, by: str) -> None:
    def run(spark, d):
        """The French files are links here; the second page begins after the first one's last row."""
        f, v, _ = _three(spark, d)
        links = f.withColumns({"link_target": F.when(F.col("mime_type") == "text/fr", F.col("file_hash")), "mime_type": F.when(F.col("mime_type") == "text/fr", "inode/symlink").otherwise(F.col("mime_type"))})
        folders = catalog(spark, d, "folders")
        last = listing.list_children(folders, links, v, None, 30, name).collect()[-1]
        return listing.list_children(folders, links, v, None, 30, name, after_row=(last[name], last["kind"], last["id"])).select("kind", "id", "name", "size", "mtime", "has_more")

    QUERIES[f"list_children_{name}"] = run
    ORACLE_SQL[f"list_children_{name}"] = f"{duckdb_with(*LISTED, 'folders')}, {_CHILDREN} SELECT kind, id, name, size, mtime, (SELECT count(*) FROM c) > 60 AS has_more FROM c ORDER BY {by}, rank, id LIMIT 30 OFFSET 30"


for _n, _b in (("name", "name"), ("mtime", "mtime DESC"), ("size", "size DESC")):
    _children(_n, _b)


# Paths: files are orders in folders of customers.

_PATHS = """p AS (SELECT folder_id, '/' || name AS path FROM folders f WHERE NOT EXISTS (SELECT 1 FROM folders u WHERE u.folder_id = f.parent_id)
    UNION ALL SELECT f.folder_id, p.path || '/' || f.name FROM p JOIN folders f ON f.parent_id = p.folder_id)"""
_ASKED = """a AS (SELECT o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN p.path || '/o' || o_orderkey WHEN 1 THEN p.path WHEN 2 THEN p.path || '/none' WHEN 3 THEN p.path || '/o' || o_orderkey || '/x' WHEN 4 THEN '/none/' || o_orderkey ELSE p.path || '/none/x' END AS path
    FROM orders JOIN p ON p.folder_id = 'c' || o_custkey), n AS (SELECT 'o' || o_orderkey AS node, p.path || '/o' || o_orderkey AS path, o_orderstatus FROM orders JOIN p ON p.folder_id = 'c' || o_custkey WHERE o_orderstatus <> 'P')"""


def _tree(spark, d):
    paths = tree.absolute_paths(catalog(spark, d, "folders")).select("folder_id", "path")
    orders = source(spark, d, "orders")
    files = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("file_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.concat(F.lit("o"), "o_orderkey").alias("file_name"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("complete").alias("status"), "o_orderstatus")
    k, c = F.col("o_orderkey"), F.col("c.path")
    own = F.concat(c, F.lit("/o"), k)
    path = F.when(k % 6 == 0, own).when(k % 6 == 1, c).when(k % 6 == 2, F.concat(c, F.lit("/none"))).when(k % 6 == 3, F.concat(own, F.lit("/x"))).when(k % 6 == 4, F.concat(F.lit("/none/"), k)).otherwise(F.concat(c, F.lit("/none/x")))
    asked = orders.join(paths.alias("c"), F.col("c.folder_id") == F.concat(F.lit("c"), "o_custkey")).select(k.alias("pos"), path.alias("path"))
    return paths, files, asked


@query(f""", {_PATHS}, {_ASKED} SELECT pos, a.path, CASE WHEN n.path IS NOT NULL THEN 'file' WHEN p.path IS NOT NULL THEN 'dir' WHEN m.path IS NOT NULL THEN 'ENOTDIR' ELSE 'ENOENT' END AS kind, coalesce(n.node, p.folder_id) AS node
    FROM a LEFT JOIN n ON n.path = a.path LEFT JOIN p ON p.path = a.path LEFT JOIN n m ON m.path = regexp_replace(a.path, '/[^/]*$', '')""", "folders")
def resolve_paths(spark, d):
    paths, files, asked = _tree(spark, d)
    return resolve.resolve(asked, paths, files).select("pos", "path", "kind", "node")


@query(f""", {_PATHS}, {_ASKED}, l AS (SELECT pos, path AS asked, CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN path WHEN 2 THEN 'x/../y' ELSE '/l' || pos END AS target FROM a)
    SELECT pos, '/l' || pos AS path, CASE WHEN pos % 4 = 3 THEN 'ELOOP' WHEN pos % 4 = 0 THEN 'file' WHEN pos % 4 = 2 THEN 'ENOENT' WHEN n.path IS NOT NULL THEN 'file' WHEN p.path IS NOT NULL THEN 'dir' WHEN m.path IS NOT NULL THEN 'ENOTDIR' ELSE 'ENOENT' END AS kind,
    CASE WHEN pos % 4 = 0 THEN 'l' || pos WHEN pos % 4 = 1 THEN coalesce(n.node, p.folder_id) END AS node
    FROM l LEFT JOIN n ON n.path = asked LEFT JOIN p ON p.path = asked LEFT JOIN n m ON m.path = regexp_replace(asked, '/[^/]*$', '')""", "folders")
def follow_paths(spark, d):
    """A link at the root for each order, to its own path, to nothing, or to itself, and a file in its place."""
    paths, files, asked = _tree(spark, d)
    k = F.col("pos")
    target = F.when(k % 4 == 1, F.col("path")).when(k % 4 == 2, "x/../y").when(k % 4 == 3, F.concat(F.lit("/l"), k))
    links = asked.select(F.concat(F.lit("l"), k).alias("file_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("l"), k).alias("file_name"), F.lit("complete").alias("status"), target.alias("link_target"))
    every = files.drop("o_orderstatus").withColumn("link_target", F.lit(None).cast("string")).unionByName(links)
    return resolve.followed(asked.select("pos", F.concat(F.lit("/l"), k).alias("path")), paths, every)


@query(f""", {_PATHS}, {_ASKED}, r AS (SELECT pos, a.path, n.node, CASE WHEN n.path IS NOT NULL THEN 'file' WHEN p.path IS NOT NULL THEN 'dir' WHEN m.path IS NOT NULL THEN 'ENOTDIR' ELSE 'ENOENT' END AS kind
    FROM a LEFT JOIN n ON n.path = a.path LEFT JOIN p ON p.path = a.path LEFT JOIN n m ON m.path = regexp_replace(a.path, '/[^/]*$', '')), c AS (SELECT *, CASE WHEN kind IN ('ENOTDIR', 'ENOENT') THEN kind WHEN kind = 'file' AND pos % 9 = 0 THEN 'ENOENT' END AS e FROM r)
    SELECT pos, path, CASE WHEN e IS NULL THEN kind END AS kind, e IS NULL AS "exists", CASE WHEN e IS NULL AND kind = 'file' THEN pos * 2 END AS size, e AS error_code FROM c""", "folders")
def stat_paths(spark, d):
    """Stat and exists; every ninth file is tombstoned."""
    paths, files, asked = _tree(spark, d)
    k = F.substring("file_id", 2, 30).cast("long")
    full = files.withColumns({"file_size": k * 2, "updated_at": k, "head_version_id": F.when(k % 9 == 0, "v")})
    versions = full.where(k % 9 == 0).select(F.col("file_id").alias("path_id"), F.lit("v").alias("version_id"), F.lit(True).alias("deleted"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ms"))
    return resolve.stats(resolve.resolve(asked, paths, files), full, versions).select("pos", "path", "kind", "exists", "size", "error_code")


@query("""SELECT i AS pos, '/l' || i AS path, CASE WHEN i % 3 = 0 THEN 't' || i END AS target, CASE i % 3 WHEN 1 THEN 'EINVAL' WHEN 2 THEN 'ENOENT' END AS error_code FROM range(60) t(i)""")
def readlink(spark, d):
    rows = spark.range(60).select(F.col("id").alias("pos"), F.concat(F.lit("/l"), "id").alias("path"))
    n = F.col("pos")
    files = rows.where(n % 3 < 2).select(F.col("path").alias("file_id"), F.lit("").alias("parent_id"), F.substring("path", 2, 30).alias("file_name"), F.lit("complete").alias("status"), F.when(n % 3 == 0, F.concat(F.lit("t"), n)).alias("link_target"))
    none = rows.select(F.lit("f").alias("folder_id"), F.lit("/none").alias("path")).distinct()
    return resolve.readlinks(resolve.resolve(rows, none, files))


@query("SELECT file_id, file_id || ':' || coalesce(head_version_id, '-') || ':' || updated_at AS cache_key FROM files", "files")
def resolve_cache_key(spark, d):
    return resolve.cache_key(catalog(spark, d, "files"))


# Reads.

@query("SELECT item_id AS file_id, CASE WHEN item_id % 7 <> 3 AND item_id % 5 <> 4 THEN sha256(text) END AS h, CASE WHEN item_id % 5 = 4 THEN 'EFBIG' WHEN item_id % 7 = 3 THEN 'ENOENT' END AS error_code FROM benchmark")
def read_many(spark, d):
    """Every third text is inline, one in seven has lost its chunks, one in five is too large."""
    i = F.col("file_id")
    b = source(spark, d, "benchmark").select(F.col("item_id").alias("file_id"), F.encode("text", "UTF-8").alias("data"))
    files = b.select("file_id", F.when(i % 5 == 4, 1 << 30).otherwise(F.octet_length("data")).cast("long").alias("file_size"), F.when((i % 3 == 0) & (i % 7 != 3), F.col("data")).alias("inline_data"))
    return chunks.read_files(files, chunks.split(b.where((i % 3 != 0) & (i % 7 != 3)), 50)).select("file_id", F.sha2("data", 256).alias("h"), "error_code")


@query("""SELECT i AS pos, h AS chunk_hash, s.size FROM (SELECT i, CASE WHEN i % 9 = 0 THEN 'none' ELSE sha256(CAST(i % 50 AS VARCHAR)) END AS h FROM range(300) t(i)) LEFT JOIN (SELECT chunk_hash, max(chunk_size) AS size FROM file_chunks GROUP BY 1) s ON s.chunk_hash = h""", "file_chunks")
def chunks_batch(spark, d):
    asked = spark.range(300).select(F.col("id").alias("pos"), F.when(F.col("id") % 9 == 0, "none").otherwise(F.sha2((F.col("id") % 50).cast("string").cast("binary"), 256)).alias("chunk_hash"))
    store = catalog(spark, d, "file_chunks").groupBy("chunk_hash").agg(F.max("chunk_size").alias("size")).withColumn("data", F.lit(b""))
    return chunks.many_chunks(asked, store).select("pos", "chunk_hash", "size")


@query("""SELECT o_orderkey AS file_id, o_orderkey % 3 AS chunk_index, CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN sha256('in' || o_orderkey) END ELSE c.chunk_hash END AS chunk_hash,
    CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN strlen('in' || o_orderkey) END ELSE c.chunk_size END AS chunk_size,
    CASE WHEN o_orderstatus = 'P' THEN 'ENOENT' WHEN CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 3 <> 0 ELSE c.chunk_hash IS NULL END THEN 'EINVAL' END AS error_code
    FROM orders LEFT JOIN file_chunks c ON c.file_id = o_orderkey AND c.chunk_index = o_orderkey % 3 WHERE o_orderstatus <> 'P' OR true""".replace("CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN sha256", "CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN sha256").replace("CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN strlen", "CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN strlen"), "file_chunks")
def chunk_at(spark, d):
    k = F.col("o_orderkey")
    o = source(spark, d, "orders")
    files = o.where("o_orderstatus <> 'P'").select(k.alias("file_id"), F.when(k % 10 == 0, F.concat(F.lit("in"), k).cast("binary")).alias("inline_data"))
    return chunks.chunk_at(o.select(k.alias("file_id"), (k % 3).alias("chunk_index")), files, catalog(spark, d, "file_chunks"))


@query("""SELECT i AS pos, i * 3 AS file_id, CASE WHEN o.o_orderkey IS NOT NULL THEN coalesce(m.chunks, 0) END AS chunks, CASE WHEN o.o_orderkey IS NOT NULL THEN coalesce(m.bytes, 0) END AS bytes, CASE WHEN o.o_orderkey IS NOT NULL THEN m.h END AS file_hash, CASE WHEN o.o_orderkey IS NULL THEN 'ENOENT' END AS error_code
    FROM range(256) t(i) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = i * 3 LEFT JOIN (SELECT file_id, count(*) AS chunks, sum(chunk_size)::BIGINT AS bytes, sha256(string_agg(chunk_hash, '' ORDER BY chunk_index)) AS h FROM file_chunks GROUP BY 1) m ON m.file_id = i * 3""", "file_chunks")
def manifests_batch(spark, d):
    files = source(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_id"))
    return chunks.manifests(spark.range(256).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("file_id")), files, catalog(spark, d, "file_chunks"))


@query("""SELECT file_id, chunk_index, c.chunk_hash, s.size AS stored FROM file_chunks c LEFT JOIN (SELECT shard_index, chunk_hash, max(chunk_size) AS size FROM file_chunks WHERE chunk_size < 45 GROUP BY 1, 2) s USING (shard_index, chunk_hash)""", "file_chunks")
def manifest_with_store(spark, d):
    c = packed_chunks(spark, d)
    store = c.where("chunk_size < 45").groupBy("shard_index", "chunk_hash").agg(F.max("chunk_size").alias("data"))
    return texted(chunks.with_bytes(c, store)).select("file_id", "chunk_index", "chunk_hash", F.col("data").alias("stored"))


@query("SELECT chunk_index, chunk_hash, chunk_size FROM file_chunks WHERE file_id = 1 ORDER BY chunk_index", "file_chunks")
def multipart_manifest(spark, d):
    return catalog(spark, d, "file_chunks").where("file_id = 1").orderBy("chunk_index").select("chunk_index", "chunk_hash", "chunk_size")


@query(", s AS (SELECT chunk_hash, max(chunk_size) AS size, count(*) AS ref_count FROM file_chunks GROUP BY 1) SELECT chunk_hash FROM s WHERE size % 7 <> 0 AND ref_count % 4 >= 1", "file_chunks")
def alive_chunks(spark, d):
    s = catalog(spark, d, "file_chunks").groupBy("chunk_hash").agg(F.max("chunk_size").alias("size"), (F.count("*") % 4).alias("ref_count"))
    return chunks.alive(s.withColumn("deleted_at", F.when(F.col("size") % 7 == 0, 1))).select("chunk_hash")


# Writes of parts, references, folders, links, modes, archives, tags, metadata, copies, accounts.

_PARTS = "l AS (SELECT file_id AS upload_id, chunk_index, chunk_hash FROM file_chunks WHERE chunk_index < 2), n AS (SELECT file_id AS upload_id, chunk_index, CASE WHEN file_id % 3 = 0 THEN 'new' || file_id ELSE chunk_hash END AS chunk_hash FROM file_chunks WHERE chunk_index > 0)"


def _parts(spark, d):
    c = catalog(spark, d, "file_chunks").withColumnRenamed("file_id", "upload_id")
    new = c.where("chunk_index > 0").withColumn("chunk_hash", F.when(F.col("upload_id") % 3 == 0, F.concat(F.lit("new"), "upload_id")).otherwise(F.col("chunk_hash")))
    of = lambda df: df.select("upload_id", "chunk_index", chunks.packed(F.col("chunk_hash")).alias("chunk_hash"))
    after, outcomes = chunks.put_parts(of(c.where("chunk_index < 2")), of(new))
    return texted(after), outcomes


@query(f""", {_PARTS} SELECT n.upload_id, n.chunk_index, CASE WHEN l.chunk_hash <> n.chunk_hash THEN 'superseded' WHEN n.chunk_hash IN (SELECT chunk_hash FROM l) THEN 'deduplicated' ELSE 'created' END AS outcome FROM n LEFT JOIN l USING (upload_id, chunk_index)""", "file_chunks")
def put_parts_outcome(spark, d):
    return _parts(spark, d)[1]


@query(f", {_PARTS} SELECT upload_id, chunk_index, coalesce(n.chunk_hash, l.chunk_hash) AS chunk_hash FROM l FULL JOIN n USING (upload_id, chunk_index)", "file_chunks")
def put_parts(spark, d):
    return _parts(spark, d)[0]


@query(""", s AS (SELECT chunk_hash, max(chunk_size) % 7 <> 0 AS live FROM file_chunks WHERE file_id % 2 = 0 GROUP BY 1)
    SELECT DISTINCT c.chunk_hash, file_id, chunk_index, CASE WHEN live IS NOT TRUE THEN 'gone' WHEN file_id % 2 = 0 THEN 'kept' ELSE 'added' END AS outcome FROM file_chunks c LEFT JOIN s USING (chunk_hash)""", "file_chunks")
def restore_refs(spark, d):
    c = packed_chunks(spark, d)
    old = c.where("file_id % 2 = 0")
    store = old.groupBy("chunk_hash").agg(F.max("chunk_size").alias("size"), F.count("*").alias("ref_count")).withColumn("deleted_at", F.when(F.col("size") % 7 == 0, 1))
    return texted(chunks.restored_refs(store, old, c)[1])


@query("""SELECT c_custkey AS folder_id, CASE WHEN c_custkey % 7 = 0 THEN 'ENOENT' WHEN c_custkey % 3 = 0 THEN 'EEXIST' WHEN c_custkey % 3 = 1 AND c_custkey <> min(c_custkey) OVER (PARTITION BY c_custkey % 3, c_custkey % 7 = 0, c_nationkey, c_custkey // 50) THEN 'EEXIST' ELSE 'OK' END AS code FROM customer""")
def mkdir(spark, d):
    """New folders in nations: where a customer's folder is, where others want to be, of names of their own, or in no folder."""
    k = F.col("c_custkey")
    c = source(spark, d, "customer")
    parent = F.when(k % 7 == 0, "nowhere").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    name = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat(F.lit("same"), F.floor(k / 50))).otherwise(F.concat(F.lit("own"), k))
    folders = catalog(spark, d, "folders").withColumn("parent_id", F.when(F.col("folder_id").startswith("c") & (F.col("parent_id") == "gone"), F.lit("x")).otherwise(F.col("parent_id")))
    folders = folders.where("parent_id is null or parent_id <> 'x'").unionByName(c.where(k % 97 == 0).select(F.concat(F.lit("c"), k).alias("folder_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name")))
    files = folders.select(F.col("folder_id").alias("file_id"), "parent_id", F.lit("f").alias("file_name"), F.lit("complete").alias("status"))
    return mutations.made_folders(folders, files, c.select(k.alias("folder_id"), parent.alias("parent_id"), name.alias("name")))[1]


@query("""SELECT x.folder_id, CASE WHEN f.folder_id IS NULL THEN 'ENOENT' WHEN EXISTS (SELECT 1 FROM folders u WHERE u.parent_id = x.folder_id) OR EXISTS (SELECT 1 FROM orders o WHERE 'c' || o_custkey = x.folder_id AND o_orderstatus <> 'P') THEN 'ENOTEMPTY' ELSE 'OK' END AS code
    FROM (SELECT folder_id FROM folders UNION SELECT 'none' || folder_id FROM folders) x LEFT JOIN folders f USING (folder_id)""", "folders")
def rmdir(spark, d):
    f = catalog(spark, d, "folders")
    files = source(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("complete").alias("status"))
    return mutations.removed_folders(f, files, f.select("folder_id").union(f.select(F.concat(F.lit("none"), "folder_id"))))[1]


@query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 9000 <= 4095 THEN o_orderkey % 9000 ELSE 420 END AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'ENOENT' WHEN o_orderkey % 9000 <= 4095 THEN 'OK' ELSE 'EINVAL' END AS code FROM orders")
def chmod(spark, d):
    k = F.col("o_orderkey")
    o = source(spark, d, "orders")
    return mutations.changed_modes(o.where(k % 5 != 0).select(k.alias("file_id"), F.lit(420).cast("long").alias("mode")), o.select(k.alias("file_id"), (k % 9000).alias("new_mode")))


@query("SELECT 'l' || file_id AS file_id, CASE WHEN status <> 'deleted' AND CAST(file_id AS BIGINT) % 2 = 0 THEN 'EEXIST' ELSE 'OK' END AS code FROM files", "files")
def symlink(spark, d):
    f = catalog(spark, d, "files").select("file_id", "parent_id", "file_name", "status")
    name = F.when(F.col("file_id").cast("long") % 2 == 0, F.col("file_name")).otherwise(F.concat(F.lit("link"), "file_name"))
    return mutations.linked(f, f.select(F.concat(F.lit("l"), "file_id").alias("file_id"), "parent_id", name.alias("file_name"), F.lit("/t").alias("link_target")))[1]


@query(f"SELECT file_id, CASE WHEN file_id IN (SELECT f.file_id {VISIBLE} AND status <> 'deleted') THEN CAST(file_id AS BIGINT) % 2 = 0 ELSE archived END AS archived FROM files", *LISTED)
def archive(spark, d):
    f, v, _ = _three(spark, d)
    return mutations.archived(f, v, f.select("file_id", (F.col("file_id").cast("long") % 2 == 0).alias("archive")))[0].select("file_id", "archived")


_EDITED = """e AS (SELECT DISTINCT path_id, CAST(path_id AS BIGINT) % 4 AS k FROM file_tags), t AS (SELECT DISTINCT path_id, tag FROM file_tags)
    SELECT path_id, tag FROM t JOIN e USING (path_id) WHERE k <> 0 AND NOT (k = 2 AND tag = 'en') UNION SELECT path_id, 'only' FROM e WHERE k = 0 UNION SELECT path_id, 'more' FROM e WHERE k IN (0, 1)"""


@query(f", {_EDITED}", "file_tags")
def edit_tags(spark, d):
    """By id modulo 4: replaced and added to, added to, removed from, and left."""
    t = catalog(spark, d, "file_tags")
    k = F.col("path_id").cast("long") % 4
    lit = lambda *x: F.array(*map(F.lit, x))
    edits = t.select("path_id").distinct().select("path_id", F.when(k == 0, lit("only")).alias("replace"), F.when(k < 2, lit("more")).alias("add"), F.when(k == 2, lit("en")).alias("remove"))
    return mutations.edited_tags(t, edits)


@query("""SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 3 <> 0 OR head_version_id IS NOT DISTINCT FROM 'v1' THEN '{"a":' || file_size || ',"b":1}' ELSE '{"a":' || file_size || '}' END AS metadata FROM files""", "files")
def patch_metadata(spark, d):
    """Every third patch expects the head v1."""
    f = catalog(spark, d, "files").withColumn("metadata", F.concat(F.lit('{"a":'), "file_size", F.lit("}")))
    lists = F.lit(None).cast("array<string>")
    patches = f.select("file_id", F.lit('{"b":1}').alias("patch"), F.when(F.col("file_id").cast("long") % 3 == 0, "v1").alias("expected"), lists.alias("replace"), lists.alias("add"), lists.alias("remove"))
    return mutations.patched(f, catalog(spark, d, "file_tags"), patches, arrow.deep_merge)[0].select("file_id", "metadata")


@query(""", d AS (SELECT DISTINCT file_id FROM file_chunks WHERE chunk_hash IN (SELECT chunk_hash FROM file_chunks GROUP BY 1 HAVING max(chunk_size) % 50 = 0))
    SELECT o_orderkey AS source, -o_orderkey AS copy, CASE WHEN o_orderstatus = 'P' THEN 'ENOENT' WHEN o_orderkey IN (SELECT file_id FROM d) THEN 'ENOCHUNK' ELSE 'OK' END AS code FROM orders""", "file_chunks")
def copy_files(spark, d):
    c, o = packed_chunks(spark, d), source(spark, d, "orders")
    store = c.groupBy("chunk_hash").agg(F.max("chunk_size").alias("size"), F.count("*").alias("ref_count")).withColumn("deleted_at", F.when(F.col("size") % 50 == 0, 1))
    files = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_id"))
    return mutations.copied(files, c, store, o.select(F.col("o_orderkey").alias("source"), (-F.col("o_orderkey")).alias("copy")))[1]


@query("SELECT 'files' AS name, count(*) AS n FROM files WHERE user_id = 'u1' UNION ALL SELECT 'tags', count(*) FROM file_tags t JOIN files f ON f.file_id = t.path_id WHERE user_id = 'u1' UNION ALL SELECT 'versions', count(*) FROM file_versions v JOIN files f ON f.file_id = v.path_id WHERE user_id = 'u1'", *LISTED)
def account_wipe(spark, d):
    f, v, t = _three(spark, d)
    owner = f.select(F.col("file_id").alias("path_id"), "user_id")
    of = lambda df: (df.join(owner, "path_id"), "user_id")
    return mutations.wiped({"files": (f, "user_id"), "tags": of(t), "versions": of(v)}, spark.createDataFrame([("u1",)], "user_id string"))[1]


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN file_size % 5 = 0 THEN 'deleted' ELSE status END AS status FROM files) GROUP BY 1", "files")
def soft_delete(spark, d):
    f = catalog(spark, d, "files")
    return reporting.counted(mutations.soft_deleted(f, f.where("file_size % 5 = 0"), 5), "status")


@query("SELECT file_id, attempts + 1 AS attempts, attempts < 5 AND attempts + 1 >= 5 AS capped FROM (SELECT file_id, file_size % 8 AS attempts FROM files)", "files")
def index_attempts(spark, d):
    return listing.marked(catalog(spark, d, "files").select("file_id", (F.col("file_size") % 8).alias("attempts")))


# Logs, sequences, uploads, concurrency.

@query("""SELECT seq, op, (SELECT count(*) FROM audit_log WHERE path_id = 3 AND seq > 5) > 20 AS has_more FROM audit_log WHERE path_id = 3 AND seq > 5 ORDER BY seq LIMIT 20""", "audit_log")
def oplog_page(spark, d):
    return folds.log_page(catalog(spark, d, "audit_log"), 3, 5, 20).select("seq", "op", "has_more")


@query(", n AS (SELECT path_id, id, ts, row_number() OVER (PARTITION BY path_id ORDER BY ts, id) AS i FROM audit_log WHERE op = 'click'), l AS (SELECT path_id, max(seq) AS last FROM audit_log WHERE op <> 'click' GROUP BY 1) SELECT path_id, id, coalesce(last, 0) + i AS seq FROM n LEFT JOIN l USING (path_id)", "audit_log")
def oplog_append(spark, d):
    log = catalog(spark, d, "audit_log")
    new = log.where("op = 'click'").withColumn("at", F.struct("ts", "id"))
    return folds.appended(log.where("op <> 'click'"), new, order="at").select("path_id", "id", "seq")


@query(", n AS (SELECT path_id, max(seq) + 1 AS next FROM audit_log GROUP BY 1) SELECT path_id, next, path_id % 2 = 0 AS applied FROM n", "audit_log")
def compact_if_unchanged(spark, d):
    log = catalog(spark, d, "audit_log")
    asked = log.groupBy("path_id").agg((F.max("seq") + 1).alias("expected_next"), F.max("ts").alias("ts"), F.sum("value").alias("value")).withColumn("expected_next", F.col("expected_next") - F.col("path_id") % 2)
    return folds.compacted_if(log, asked)[1]


_SESSIONS = "s AS (SELECT id, CASE seq % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'finalizing' WHEN 2 THEN 'aborting' ELSE 'done' END AS state, seq * 1000 AS expires_at, seq % 6 AS attempts, seq % 3 = 0 AS failed FROM audit_log), e AS (SELECT *, state <> 'done' AND expires_at < 40000 AS due FROM s)"


@query(f""", {_SESSIONS} SELECT id, CASE WHEN due AND failed AND attempts + 1 >= 5 THEN 'poisoned' WHEN due AND NOT failed THEN 'aborted' ELSE state END AS new_state, attempts + (due AND failed)::INT AS new_attempts FROM e""", "audit_log")
def expire_uploads(spark, d):
    s = F.col("seq")
    rows = catalog(spark, d, "audit_log").select("id", F.when(s % 4 == 0, "open").when(s % 4 == 1, "finalizing").when(s % 4 == 2, "aborting").otherwise("done").alias("state"), (s * 1000).alias("expires_at"), (s % 6).alias("attempts"), (s % 3 == 0).alias("failed"))
    return folds.expired_uploads(rows, 40_000).select("id", "new_state", "new_attempts")


@query()
def adaptive_concurrency(spark, d):
    """Lanes after each path's trace; held against plain Python in the tests."""
    rows = catalog(spark, d, "audit_log").withColumns({"ms": F.col("value") % 7 + 50, "ok": F.col("seq") % 23 != 0})
    return folds.concurrency(rows, "path_id", "seq", "ms", "ok")


@query()
def justified_rows(spark, d):
    """Photos of each folder in rows of one width; held against plain Python in the tests."""
    f = catalog(spark, d, "files").select(F.coalesce("parent_id", F.lit("")).alias("album"), "file_id", (F.lit(0.75) + F.col("file_size") % 5 * 0.25).alias("aspect"))
    return folds.justified(f, "album", "file_id", "aspect", 1000.0, 220.0, 4.0)


# Sets, counts, orders and small functions.

@query("SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM files WHERE file_size % 3 = 0) THEN 'in' ELSE 'out' END AS place FROM files WHERE status = 'complete' AND mime_type LIKE 'image/%'", "files")
def album_membership(spark, d):
    f = catalog(spark, d, "files")
    shared, album = listing.shared_album(f), f.where("file_size % 3 = 0").select("file_id")
    inside = shared.join(album, "file_id", "left_semi").withColumn("place", F.lit("in"))
    return inside.unionByName(shared.join(album, "file_id", "left_anti").withColumn("place", F.lit("out"))).select("file_id", "place")


@query("SELECT pos, file_id, f.file_name FROM (SELECT i AS pos, lpad(CAST(i * 7 % 900 AS VARCHAR), 12, '0') AS file_id FROM range(100) t(i)) JOIN (SELECT * FROM files WHERE status = 'complete' AND mime_type LIKE 'image/%') f USING (file_id)", "files")
def share_album(spark, d):
    asked = spark.range(100).select(F.col("id").alias("pos"), F.lpad((F.col("id") * 7 % 900).cast("string"), 12, "0").alias("file_id"))
    return asked.join(listing.shared_album(catalog(spark, d, "files")), "file_id").select("pos", "file_id", "file_name")


@query("SELECT file_id, file_name, created_at FROM files WHERE status <> 'deleted' AND mime_type LIKE 'image/%' ORDER BY created_at, file_id LIMIT 60", "files")
def gallery_oldest(spark, d):
    return listing.photos(catalog(spark, d, "files")).orderBy("created_at", "file_id").limit(60).select("file_id", "file_name", "created_at")


@query("SELECT folder_id, name FROM folders WHERE parent_id = 'n3' ORDER BY name, folder_id", "folders")
def folders_by_name(spark, d):
    return catalog(spark, d, "folders").where("parent_id = 'n3'").orderBy("name", "folder_id").select("folder_id", "name")


@query("SELECT DISTINCT shard_index, file_id FROM file_chunks", "file_chunks")
def shard_set(spark, d):
    return catalog(spark, d, "file_chunks").select("shard_index", "file_id").distinct()


@query("SELECT user_id, greatest(count(*), 30 + min(CAST(file_id AS BIGINT))) AS total FROM files WHERE status <> 'deleted' GROUP BY 1", "files")
def total_files(spark, d):
    f = catalog(spark, d, "files")
    counters = f.where("status <> 'deleted'").groupBy("user_id").agg((F.min(F.col("file_id").cast("long")) + 30).alias("counter"))
    return reporting.total_files(f, counters)


@query("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM file_tags) AS tags, (SELECT count(DISTINCT tag) FROM file_tags) AS distinct_tags, (SELECT count(*) FROM audit_log) AS audit", "files", "file_tags", "audit_log")
def scalar_counts(spark, d):
    f, t, a = (catalog(spark, d, x) for x in ("files", "file_tags", "audit_log"))
    one = lambda df, c: df.agg(c).scalar()
    return spark.range(1).select(one(f, F.count("*")).alias("files"), one(t, F.count("*")).alias("tags"), one(t, F.count_distinct("tag")).alias("distinct_tags"), one(a, F.count("*")).alias("audit"))


@query("SELECT file_id, count(*) AS hits FROM (SELECT f.file_id FROM files f JOIN files g ON f.file_id = g.file_id AND f.head_version_id IS NOT DISTINCT FROM (CASE WHEN g.file_size % 2 = 0 THEN g.head_version_id ELSE 'other' END)) GROUP BY 1", "files")
def version_cache_hits(spark, d):
    """A cached variant is for one head, none included."""
    f = catalog(spark, d, "files")
    cached = f.select(F.col("file_id").alias("c_id"), F.when(F.col("file_size") % 2 == 0, F.col("head_version_id")).otherwise("other").alias("c_head"))
    return f.join(cached, (F.col("file_id") == F.col("c_id")) & F.col("head_version_id").eqNullSafe(F.col("c_head"))).groupBy("file_id").agg(F.count("*").alias("hits"))


@query("SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 2 = 0 THEN 'thumb' WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 'medium' END AS variant, 'custom:w' || (file_size % 300) || 'h200cover' AS key FROM files", "files")
def variants(spark, d):
    """The first of the wanted variants that a file has, and the key of one of any size."""
    f = catalog(spark, d, "files")
    n = F.col("file_id").cast("long")
    have = f.where(n % 2 == 0).select("file_id", F.lit("thumb").alias("variant")).union(f.where(n % 3 == 0).select("file_id", F.lit("medium")))
    best = listing.best_variant(f, have, ["thumb", "medium", "large"])
    return best.select("file_id", "variant", scalars.variant_key(F.col("file_size") % 300, F.lit(200), F.lit("cover")).alias("key"))


@query("SELECT shard_index, bytes, 32 + sum(bytes) OVER () // 5368709120 + (min(bytes) OVER () > 100)::INT AS pool FROM (SELECT shard_index, sum(chunk_size)::BIGINT AS bytes FROM file_chunks GROUP BY 1)", "file_chunks")
def grown_pool(spark, d):
    """The pool grows by a shard when all are full."""
    return reporting.grown_pool(reporting.shard_distribution(catalog(spark, d, "file_chunks")).select("shard_index", "bytes"), 100)


@query("SELECT path_id, array_to_string(list_sort(list(k || '=' || tag)), ',') AS m FROM (SELECT DISTINCT path_id, substr(tag, 1, 2) AS k, max(tag) OVER (PARTITION BY path_id, substr(tag, 1, 2)) AS tag FROM file_tags) GROUP BY 1", "file_tags")
def metadata_map(spark, d):
    """Rows of a key and a value as one map a path."""
    t = catalog(spark, d, "file_tags").groupBy("path_id", F.substring("tag", 1, 2).alias("key")).agg(F.max("tag").alias("value"))
    m = listing.as_map(t, "path_id")
    return m.select("path_id", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("m"))


@query("SELECT page_id, upper(hex(encode(url))) AS hex, url AS back, upper(printf('%08x', page_id % 4294967296)) AS big, 'u' || page_id || '#v' AS ref, regexp_matches(url, '^[A-Za-z0-9._-]{1,128}$') AS plain FROM pages")
def encodings(spark, d):
    p = source(spark, d, "pages")
    b = scalars.base64url(F.encode("url", "UTF-8"))
    return p.select("page_id", F.hex(F.encode("url", "UTF-8")).alias("hex"), scalars.from_base64url(b).cast("string").alias("back"), scalars.big_endian(F.col("page_id"), 4).alias("big"), scalars.ref_id(F.concat(F.lit("u"), "page_id"), F.lit("v")).alias("ref"), scalars.plain_name(F.col("url")).alias("plain"))


@query("SELECT item_id, sha256(text) AS back, strlen(text) + 28 AS sealed FROM benchmark")
def sealed_chunks(spark, d):
    """Chunks sealed with AES-GCM and opened again; equal chunks of one key are sealed alike."""
    b = source(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))
    sealed = b.select("item_id", scalars.sealed(F.col("data"), F.lit(b"0123456789abcdef")).alias("s"))
    return sealed.select("item_id", F.sha2(scalars.opened(F.col("s"), F.lit(b"0123456789abcdef")), 256).alias("back"), F.octet_length("s").cast("long").alias("sealed"))


@query("SELECT file_id, CAST(least(100 * pow(2, file_size % 12), 30000) AS BIGINT) AS ms, least(file_size % 400, 320) AS width, CASE WHEN file_size % 400 > 0 THEN CAST(floor(least(file_size % 400, 320) / 4.0) AS BIGINT) ELSE 0 END AS height FROM files", "files")
def upload_backoff(spark, d):
    n = F.col("file_size")
    return catalog(spark, d, "files").select("file_id", scalars.upload_backoff(n % 12).alias("ms"), F.least(n % 400, F.lit(320)).alias("width"), scalars.wave_height(F.least(n % 400, F.lit(320))).alias("height"))


@query("SELECT op, path_id, count(DISTINCT ts // 600000) AS calls FROM audit_log GROUP BY 1, 2", "audit_log")
def coalesced_calls(spark, d):
    """Equal requests within one window of time are one call."""
    return folds.coalesced(catalog(spark, d, "audit_log"), ["op", "path_id"], "ts", 600_000).groupBy("op", "path_id").agg(F.count("*").alias("calls"))


@query("SELECT shard_index, bucket, max(bytes) AS bytes FROM (SELECT shard_index, file_id // 1000 AS bucket, sum(chunk_size) OVER (PARTITION BY shard_index ORDER BY file_id, chunk_index)::BIGINT AS bytes FROM file_chunks) GROUP BY 1, 2", "file_chunks")
def capacity_samples(spark, d):
    """The last figure of each shard in each window of a monitor that looks once a window."""
    c = catalog(spark, d, "file_chunks")
    w = Window.partitionBy("shard_index").orderBy("file_id", "chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return folds.throttled(c.select("shard_index", F.col("file_id").alias("at"), F.sum("chunk_size").over(w).alias("bytes")), "shard_index", "at", "bytes", 1000)


@query("SELECT page_id, len(regexp_extract_all(substring(html, 1, 1024), '</?[a-zA-Z]+')) AS keywords, len(regexp_extract_all(substring(html, 1, 1024), '\"[^\"]*\"')) AS strings FROM pages")
def code_tokens(spark, d):
    t = scalars.code_tokens(F.col("html"), r"</?[a-zA-Z]+")
    return source(spark, d, "pages").select("page_id", t["keywords"].alias("keywords"), t["strings"].alias("strings"))


@query("SELECT op, count(*) AS n FROM audit_log GROUP BY 1 UNION ALL SELECT 'new', (SELECT count(DISTINCT path_id) FROM audit_log)", "audit_log")
def audit_insert(spark, d):
    log = catalog(spark, d, "audit_log")
    new = log.select("path_id").distinct().select(F.concat(F.lit("n"), "path_id").alias("id"), F.lit("new").alias("op"), "path_id")
    return reporting.counted(history.audited(log, new), "op")


# Tiers, moves, removals, uploads' ends, limits.

@query(""", o AS (SELECT user_id, file_id, file_size AS n, row_number() OVER (PARTITION BY user_id ORDER BY file_id) AS i FROM files),
    b AS (SELECT user_id, '' AS file_id, 0::BIGINT AS i, '' AS tier, 0::BIGINT AS used FROM (SELECT DISTINCT user_id FROM o)
    UNION ALL SELECT o.user_id, o.file_id, o.i, CASE WHEN n <= 1500 AND used + n <= 60000 THEN 'inline' ELSE 'chunks' END, used + CASE WHEN n <= 1500 AND used + n <= 60000 THEN n ELSE 0 END FROM b JOIN o ON o.user_id = b.user_id AND o.i = b.i + 1)
    SELECT user_id, file_id, tier, used AS inline_bytes FROM b WHERE i > 0""", "files")
def write_tiers(spark, d):
    return folds.tiers(catalog(spark, d, "files"), "user_id", "file_id", "file_size", 1500, 60_000)


@query(""", o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i, (CAST(floor(value) AS BIGINT) - 40) * 500000000 AS x FROM audit_log),
    b AS (SELECT path_id, i, greatest(x, 0) AS used, greatest(x, 0) AS peak FROM o WHERE i = 1 UNION ALL SELECT o.path_id, o.i, greatest(b.used + x, 0), greatest(b.peak, b.used + x) FROM b JOIN o ON o.path_id = b.path_id AND o.i = b.i + 1)
    SELECT path_id, 32 + max(peak) // 5368709120 AS pool FROM b GROUP BY 1""", "audit_log")
def pool_high_water(spark, d):
    """A pool never shrinks: it follows the most that was ever stored."""
    log = catalog(spark, d, "audit_log").withColumn("delta", (F.floor("value") - 40) * 500_000_000)
    return folds.usage(log, "path_id", "seq", "delta").select("path_id", scalars.pool_size(F.col("peak")).alias("pool"))


_MOVES = """m AS (SELECT 'c' || c_custkey AS folder_id, CASE c_custkey % 5 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'c' || c_custkey WHEN 2 THEN 'n' || c_nationkey ELSE 'r2' END AS parent_id, CASE WHEN c_custkey % 5 = 4 THEN 'NATION' ELSE c_name END AS name FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 'c' || (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 97 <> 0), n_name FROM nation UNION ALL SELECT 'gone', 'r1', 'x')"""


@query(f""", {_MOVES}, up AS (SELECT folder_id AS f, folder_id AS above FROM folders UNION ALL SELECT up.f, g.parent_id FROM up JOIN folders g ON g.folder_id = up.above JOIN folders h ON h.folder_id = g.parent_id)
    SELECT m.folder_id, CASE WHEN f.folder_id IS NULL OR p.folder_id IS NULL THEN 'ENOENT' WHEN EXISTS (SELECT 1 FROM up WHERE up.f = m.parent_id AND above = m.folder_id) THEN 'EINVAL'
    WHEN EXISTS (SELECT 1 FROM folders t WHERE coalesce(t.parent_id, '') = m.parent_id AND t.name = m.name AND t.folder_id <> m.folder_id) THEN 'EEXIST' ELSE 'OK' END AS code
    FROM m LEFT JOIN folders f ON f.folder_id = m.folder_id LEFT JOIN folders p ON p.folder_id = m.parent_id""", "folders")
def move_folders(spark, d):
    """Customers' folders to nowhere, into themselves, to where they are, and to a region; nations into a customer below them."""
    f, c, n = catalog(spark, d, "folders"), source(spark, d, "customer"), source(spark, d, "nation")
    k = F.col("c_custkey")
    into = F.when(k % 5 == 0, "nowhere").when(k % 5 == 1, F.concat(F.lit("c"), k)).when(k % 5 == 2, F.concat(F.lit("n"), "c_nationkey")).otherwise("r2")
    moves = c.select(F.concat(F.lit("c"), k).alias("folder_id"), into.alias("parent_id"), F.when(k % 5 == 4, "NATION").otherwise(F.col("c_name")).alias("name"))
    least = c.where(k % 97 != 0).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("k"))
    nations = n.join(least, "n_nationkey", "left").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "k"), "n_name")
    moves = moves.union(nations).union(spark.createDataFrame([("gone", "r1", "x")], "folder_id string, parent_id string, name string"))
    above = tree.walked(f, trail=True).select("folder_id", F.explode("trail").alias("t")).select("folder_id", F.col("t.folder_id").alias("above"))
    files = f.select(F.col("folder_id").alias("file_id"), F.lit("none").alias("parent_id"), F.lit("f").alias("file_name"), F.lit("complete").alias("status"))
    return mutations.moved_folders(f, files, moves, above)[1]


@query(""", s AS (SELECT folder_id, 0 AS depth FROM folders WHERE folder_id = 'r1' UNION ALL SELECT f.folder_id, s.depth + 1 FROM s JOIN folders f ON f.parent_id = s.folder_id)
    SELECT 0 AS step, 0 AS depth, 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 'tombstone' ELSE 'delete' END AS action FROM orders WHERE o_orderstatus <> 'P' AND 'c' || o_custkey IN (SELECT folder_id FROM s)
    UNION ALL SELECT 1, -depth, folder_id, 'remove' FROM s""", "folders")
def removal_plan(spark, d):
    files = source(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("file_id"), (F.col("o_orderkey") % 4).alias("user_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("complete").alias("status"))
    return mutations.removal(tree.subtree(catalog(spark, d, "folders"), "r1"), files, spark.range(2).select(F.col("id").alias("user_id")))


@query(""", t AS (SELECT DISTINCT path_id, tag FROM file_tags WHERE tag LIKE 'quality%'), r AS (SELECT file_id, row_number() OVER w AS place, lead(file_id) OVER w AS other FROM files WINDOW w AS (PARTITION BY user_id, coalesce(parent_id, ''), mime_type ORDER BY updated_at DESC, file_id DESC))
    SELECT path_id, tag FROM t JOIN r ON file_id = path_id WHERE place = 1 UNION SELECT file_id, tag FROM r JOIN t ON other = path_id WHERE place = 1 AND file_id NOT IN (SELECT path_id FROM t)""", "files", "file_tags")
def carry_tags(spark, d):
    f = catalog(spark, d, "files").withColumn("file_name", F.col("mime_type"))
    return mutations.carried_tags(catalog(spark, d, "file_tags").where("tag like 'quality%'"), f)


@query("""SELECT DISTINCT path_id, version_id, size FROM (SELECT 't' || CAST(substr(path_id, 2) AS BIGINT) // 2 AS path_id, version_id, CASE WHEN CAST(substr(path_id, 2) AS BIGINT) % 2 = 0 THEN size ELSE size END AS size,
    row_number() OVER (PARTITION BY CAST(substr(path_id, 2) AS BIGINT) // 2, version_id ORDER BY CAST(substr(path_id, 2) AS BIGINT) % 2) AS place FROM versions_history) WHERE place = 1""", "versions_history")
def rename_with_history(spark, d):
    """Even paths move onto odd ones, which keep what the even ones do not have."""
    n = F.substring("path_id", 2, 30).cast("long")
    v = catalog(spark, d, "versions_history")
    at = v.withColumn("path_id", F.when(n % 2 == 1, F.concat(F.lit("t"), F.floor(n / 2))).otherwise(F.col("path_id")))
    pairs = v.where(n % 2 == 0).select(F.col("path_id").alias("source"), F.concat(F.lit("t"), F.floor(n / 2)).alias("target")).distinct()
    return history.moved(at, pairs).select("path_id", "version_id", "size")


@query("""SELECT path_id, version_id, deleted FROM versions_history WHERE CAST(substr(path_id, 2) AS BIGINT) % 3 <> 2 UNION ALL SELECT DISTINCT path_id, 'gone', true FROM versions_history WHERE CAST(substr(path_id, 2) AS BIGINT) % 3 = 1""", "versions_history")
def unlink_by_flag(spark, d):
    """A third of the paths stay, a third are unlinked by a user who keeps versions, a third by one who does not."""
    v = catalog(spark, d, "versions_history")
    n = F.substring("path_id", 2, 30).cast("long") % 3
    paths = v.select("path_id").distinct().where(n > 0).withColumn("user_id", n)
    flags = spark.range(3).select(F.col("id").alias("user_id"), (F.col("id") == 1).alias("enabled"))
    return history.unlinked_by_user(v, paths, flags, 5, "gone").select("path_id", "version_id", "deleted")


@query(""", e AS (SELECT * FROM file_chunks), l AS (SELECT file_id, chunk_index, CASE WHEN chunk_size = 7 THEN 'x' ELSE chunk_hash END AS h FROM file_chunks WHERE chunk_size <> 11), r AS (SELECT e.*, CASE WHEN h IS NULL THEN 2 WHEN h <> chunk_hash THEN 1 ELSE 0 END AS c FROM e LEFT JOIN l USING (file_id, chunk_index))
    SELECT file_id AS upload_id, CASE max(c) WHEN 2 THEN 'ENOENT' WHEN 1 THEN 'EBADF' ELSE 'OK' END AS code, CASE WHEN max(c) = 0 THEN sum(chunk_size)::BIGINT END AS bytes, CASE WHEN max(c) = 0 THEN sha256(string_agg(chunk_hash, '' ORDER BY chunk_index)) END AS file_hash FROM r GROUP BY 1""", "file_chunks")
def finalize_uploads(spark, d):
    c = catalog(spark, d, "file_chunks").withColumnRenamed("file_id", "upload_id")
    there = c.where("chunk_size <> 11").withColumn("chunk_hash", F.when(F.col("chunk_size") == 7, "x").otherwise(F.col("chunk_hash")))
    return chunks.finalized(c.select("upload_id", "chunk_index", "chunk_hash", "chunk_size"), there)


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'root' WHEN 2 THEN 'json' WHEN 3 THEN 'key' WHEN 4 THEN 'array' WHEN 5 THEN 'size' END AS error, CASE event_id % 4 WHEN 1 THEN 'tag' WHEN 2 THEN 'repeated' WHEN 3 THEN 'count' END AS tags FROM events")
def metadata_limits(spark, d):
    i = F.col("event_id")
    text = F.when(i % 6 == 0, F.col("props")).when(i % 6 == 1, "[1]").when(i % 6 == 2, "{").when(i % 6 == 3, F.concat(F.lit('{"'), F.repeat(F.lit("k"), 1025), F.lit('":1}'))).when(i % 6 == 4, F.concat(F.lit('{"a":['), F.repeat(F.lit("1,"), 1024), F.lit("1]}"))).otherwise(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 65_536), F.lit('"}')))
    lit = lambda *x: F.array(*map(F.lit, x))
    tags = F.when(i % 4 == 0, lit("a", "b:c/d")).when(i % 4 == 1, lit("a", "b c")).when(i % 4 == 2, lit("a", "b", "a")).otherwise(F.array_repeat(F.lit("a"), 33))
    return source(spark, d, "events").select("event_id", arrow.metadata_error(text).alias("error"), scalars.tags_error(tags).alias("tags"))


@query("SELECT file_id, f.file_hash, f.file_size FROM files f JOIN (SELECT file_hash, file_size FROM files GROUP BY 1, 2 HAVING count(*) > 1) USING (file_hash, file_size)", "files")
def duplicate_rows(spark, d):
    f = catalog(spark, d, "files")
    return f.join(reporting.duplicates(f, "file_hash", "file_size").drop("n"), ["file_hash", "file_size"]).select("file_id", "file_hash", "file_size")


# Other forms of rows.

@query("SELECT i AS pos, lpad(CAST(i * 3 % 1100 AS VARCHAR), 12, '0') AS node, s.size, s.mtime, s.mime_type, s.head_version_id, s.file_hash, CASE WHEN s.mime_type IS NOT NULL THEN coalesce(t.tags, '') END AS tags, CASE WHEN s.mime_type IS NULL THEN 'ENOENT' END AS error_code FROM range(300) r(i)"
       f" LEFT JOIN (SELECT f.file_id, coalesce(v.size, f.file_size) AS size, coalesce(v.mtime_ms, f.updated_at) AS mtime, f.mime_type, f.head_version_id, f.file_hash {VISIBLE} AND f.status <> 'deleted') s ON s.file_id = lpad(CAST(i * 3 % 1100 AS VARCHAR), 12, '0')"
       " LEFT JOIN (SELECT path_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM file_tags GROUP BY 1) t ON t.path_id = lpad(CAST(i * 3 % 1100 AS VARCHAR), 12, '0')", *LISTED)  # fmt: skip
def file_info(spark, d):
    nodes = spark.range(300).select(F.col("id").alias("pos"), F.lpad((F.col("id") * 3 % 1100).cast("string"), 12, "0").alias("node"))
    return listing.file_info(nodes, *_three(spark, d))


@query("SELECT file_id AS \"fileId\", file_name AS \"fileName\", file_size AS \"fileSize\", mime_type AS \"mimeType\", updated_at AS \"updatedAt\", CASE WHEN file_size % 2 = 0 THEN 420 | 2048 ELSE 420 END AS mode FROM files", "files")
def api_rows(spark, d):
    return listing.api_rows(catalog(spark, d, "files").withColumns({"mode": F.lit(0o644), "shared": F.col("file_size") % 2 == 0}))


@query("SELECT file_id FROM files WHERE (SELECT max(r_regionkey) FROM region) >= 3", "files")
def feature_gate(spark, d):
    return listing.gated(catalog(spark, d, "files"), source(spark, d, "region").select(F.col("r_regionkey").alias("version")), 3).select("file_id")


@query("SELECT chunk_index, chunk_hash FROM file_chunks WHERE file_id = 1 AND chunk_index > 0 ORDER BY chunk_index LIMIT 2", "file_chunks")
def pull_chunks(spark, d):
    return chunks.pulled(catalog(spark, d, "file_chunks"), 1, 0, 2).select("chunk_index", "chunk_hash")


@query("SELECT 'json' AS kind, file_id, file_name, file_size FROM files UNION ALL SELECT 'csv', file_id, file_name, file_size FROM files", "files")
def export_round_trip(spark, d):
    rows = catalog(spark, d, "files").select("file_id", "file_name", "file_size")
    schema, root = "file_id string, file_name string, file_size long", scratch_path(spark, "exports")
    read = lambda kind: spark.read.schema(schema).option("header", "true").format(kind).load(exported(rows, root, kind)).select(F.lit(kind).alias("kind"), "*")
    return read("json").union(read("csv"))


@query()
def binary_files(spark, d):
    """The files of the tables themselves, as rows; held against the file system in the tests."""
    return read_files(spark, d, "*.parquet").select("name", "size")


@query()
def waveforms(spark, d):
    """Peaks of the texts' bytes as sound; held against Python in the tests."""
    return source(spark, d, "benchmark").select("item_id", arrow.waveform(F.encode("text", "UTF-8"), 16).alias("peaks"))
