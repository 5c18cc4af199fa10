"""Queries over chunks, trees, scalars, vectors, folds, mutations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.adapters import catalog, duckdb_with, source
from catalith.functions import arrow, scalars
from catalith.operators import chunks, folds, mutations, reporting, search, tree
from catalith.scratch import scratch_path
from catalith.sources import write_snapshot

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{duckdb_with(*tables)} {sql}" if tables else sql
        return f

    return add


@query("SELECT file_id, count(*) AS chunks, sum(chunk_size)::BIGINT AS bytes, sha256(string_agg(chunk_hash, '' ORDER BY chunk_index)) AS file_hash FROM file_chunks GROUP BY 1", "file_chunks")
def manifest(spark, d):
    return chunks.manifest(catalog(spark, d, "file_chunks")).drop("manifest")


@query("SELECT file_id, chunk_index, chunk_size, coalesce(sum(chunk_size) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM file_chunks", "file_chunks")
def chunk_offsets(spark, d):
    return chunks.offsets(catalog(spark, d, "file_chunks"))


@query("""SELECT file_id, chunk_index, greatest(30 - o, 0) AS "from", least(70, o + chunk_size) - o AS "to" FROM (SELECT *, coalesce(sum(chunk_size) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM file_chunks)
    WHERE o + chunk_size > 30 AND o < 70""", "file_chunks")
def range_read(spark, d):
    return chunks.range_parts(catalog(spark, d, "file_chunks"), 30, 70)


@query("""SELECT item_id, i::INT AS chunk_index, sha256(unhex(part)) AS chunk_hash, (length(part) // 2)::BIGINT AS chunk_size
    FROM (SELECT item_id, i, substring(hex(encode(text)), 128 * i + 1, 128) AS part FROM (SELECT item_id, text, unnest(range(greatest((strlen(text) + 63) // 64, 1))) AS i FROM benchmark))""")
def chunk_split(spark, d):
    b = source(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))
    return chunks.split(b, 64, "item_id").drop("data")


QUERIES["chunk_split_all"], ORACLE_SQL["chunk_split_all"] = chunk_split, ORACLE_SQL["chunk_split"]


@query("SELECT item_id, sha256(text) AS h FROM benchmark")
def read_file(spark, d):
    b = source(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))
    return chunks.read(chunks.split(b, 50, "item_id"), "item_id").select("item_id", F.sha2("data", 256).alias("h"))


#: The store has even files; put are odd ones, and again every second even one, whose references are there.
_STORED = "s AS (SELECT chunk_hash, max(chunk_size) AS size, count(*) AS ref_count, CASE WHEN max(chunk_size) % 7 = 0 THEN 1000 END AS deleted_at FROM file_chunks {where} GROUP BY 1)"
_OLD = _STORED.format(where="WHERE file_id % 2 = 0")
_EVERY = _STORED.format(where="")
_PUT = "n AS (SELECT * FROM file_chunks WHERE file_id % 2 <> 0 OR file_id % 4 = 0)"


def packed_chunks(spark, d):
    """The chunks of files with packed hashes, for what moves many of them."""
    return catalog(spark, d, "file_chunks").withColumn("chunk_hash", chunks.packed(F.col("chunk_hash")))


def texted(df):
    return df.withColumn("chunk_hash", chunks.unpacked(F.col("chunk_hash")))


def _put(spark, d):
    c = packed_chunks(spark, d)
    old = c.where("file_id % 2 = 0")
    return chunks.put(_store_of(old), old, c.where("file_id % 2 <> 0 OR file_id % 4 = 0"))


@query(f""", {_OLD}, {_PUT}, f AS (SELECT chunk_hash, count(*) AS more FROM (SELECT DISTINCT chunk_hash, file_id, chunk_index FROM n EXCEPT SELECT chunk_hash, file_id, chunk_index FROM file_chunks WHERE file_id % 2 = 0) GROUP BY 1),
    t AS (SELECT chunk_hash, max(chunk_size) AS new_size FROM n GROUP BY 1)
    SELECT chunk_hash, coalesce(size, new_size) AS size, (coalesce(ref_count, 0) + coalesce(more, 0))::BIGINT AS ref_count, CASE WHEN new_size IS NULL THEN deleted_at END AS deleted_at FROM s FULL JOIN t USING (chunk_hash) LEFT JOIN f USING (chunk_hash)""", "file_chunks")
def dedup_put(spark, d):
    return texted(_put(spark, d)[0])


@query(f""", {_OLD}, {_PUT} SELECT n.chunk_hash, file_id, chunk_index, CASE WHEN s.chunk_hash IS NULL AND row_number() OVER (PARTITION BY n.chunk_hash ORDER BY file_id, chunk_index) = 1 THEN 'created' ELSE 'deduplicated' END AS outcome
    FROM n LEFT JOIN s USING (chunk_hash)""", "file_chunks")
def put_outcome(spark, d):
    return texted(_put(spark, d)[1]).select("chunk_hash", "file_id", "chunk_index", "outcome")


_GONE = "g AS (SELECT chunk_hash, count(*) AS gone FROM file_chunks WHERE file_id % 4 = 0 GROUP BY 1)"


@query(f""", {_EVERY}, {_GONE}
    SELECT s.chunk_hash, size, greatest(ref_count - coalesce(gone, 0), 0) AS ref_count, CASE WHEN ref_count - coalesce(gone, 0) <= 0 AND gone IS NOT NULL THEN coalesce(deleted_at, 5000) ELSE deleted_at END AS deleted_at FROM s LEFT JOIN g USING (chunk_hash)""", "file_chunks")
def refcount_drop(spark, d):
    c = catalog(spark, d, "file_chunks")
    return chunks.dropped_refs(_store_of(c), c, c.where("file_id % 4 = 0").select("file_id").distinct(), 5000)


@query(f""", {_EVERY}, {_GONE},
    a AS (SELECT s.chunk_hash, greatest(ref_count - coalesce(gone, 0), 0) AS r, CASE WHEN ref_count - coalesce(gone, 0) <= 0 AND gone IS NOT NULL THEN coalesce(deleted_at, 5000) ELSE deleted_at END AS x FROM s LEFT JOIN g USING (chunk_hash))
    SELECT chunk_hash, CASE WHEN x < 33000 - 30000 AND r = 0 THEN 'delete' WHEN x < 33000 - 30000 THEN 'unmark' ELSE 'keep' END AS action FROM a""", "file_chunks")
def gc_mark_sweep(spark, d):
    return chunks.sweep(refcount_drop(spark, d), 33_000).select("chunk_hash", "action")


def _store_of(c):
    return c.groupBy("chunk_hash").agg(F.max("chunk_size").alias("size"), F.count("*").alias("ref_count")).withColumn("deleted_at", F.when(F.col("size") % 7 == 0, F.lit(1000).cast("long")))


for _name in ("dedup_put", "put_outcome", "refcount_drop", "gc_mark_sweep"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]


@query("""SELECT coalesce(e.file_id, l.file_id) AS upload_id, coalesce(e.chunk_index, l.chunk_index) AS chunk_index,
    CASE WHEN e.file_id IS NULL THEN 'EXTRA' WHEN l.file_id IS NULL THEN 'ENOENT' WHEN e.chunk_hash <> l.h THEN 'EBADF' ELSE 'OK' END AS code
    FROM (SELECT * FROM file_chunks WHERE chunk_size > 5) e FULL JOIN (SELECT *, CASE WHEN chunk_size % 11 = 0 THEN 'x' ELSE chunk_hash END AS h FROM file_chunks WHERE chunk_size < 45) l ON e.file_id = l.file_id AND e.chunk_index = l.chunk_index""", "file_chunks")
def multipart_verify(spark, d):
    c = catalog(spark, d, "file_chunks").select(F.col("file_id").alias("upload_id"), "chunk_index", "chunk_hash", "chunk_size")
    there = c.where("chunk_size < 45").withColumn("chunk_hash", F.when(F.col("chunk_size") % 11 == 0, "x").otherwise(F.col("chunk_hash")))
    return chunks.verified(c.where("chunk_size > 5").drop("chunk_size"), there.drop("chunk_size"))


@query("SELECT file_id AS upload_id, count(DISTINCT chunk_index) AS indexes, sum(chunk_size)::BIGINT AS bytes FROM file_chunks GROUP BY 1", "file_chunks")
def uploads_landed(spark, d):
    return chunks.landed(catalog(spark, d, "file_chunks").withColumnRenamed("file_id", "upload_id"))


@query("SELECT a.file_id, a.chunk_index, coalesce(k.s, a.chunk_index % 32) AS shard_index FROM file_chunks a LEFT JOIN (SELECT chunk_hash, min(shard_index) AS s FROM file_chunks WHERE file_id % 5 = 0 GROUP BY 1) k USING (chunk_hash)", "file_chunks")
def place_by_hash(spark, d):
    c = catalog(spark, d, "file_chunks")
    placed = chunks.shard_of(c.drop("shard_index"), c.where("file_id % 5 = 0"), (F.col("chunk_index") % 32).cast("long"))
    return placed.select("file_id", "chunk_index", "shard_index")


@query()
def place_chunk(spark, d):
    c = catalog(spark, d, "file_chunks")
    return c.select("file_id", "chunk_index", arrow.place(F.col("file_id").cast("string"), F.col("chunk_index"), F.lit("u1"), 32).alias("shard"))


@query("""SELECT o_orderkey, s, cs AS chunk_size, CASE WHEN cs > 0 THEN (s + cs - 1) // cs ELSE 0 END AS chunks, 32 + s // 5368709120 AS pool FROM (SELECT *, CASE WHEN s <= 0 THEN 0 WHEN s <= 1048576 THEN s WHEN s <= 67108864 THEN 1048576 WHEN s <= 536870912 THEN 1572864 ELSE 2097152 END AS cs
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(floor(o_totalprice * (1 + o_orderkey % 9) * (1 + (o_orderkey % 4) * 7000)) AS BIGINT) END AS s FROM orders))""")
def chunk_spec(spark, d):
    s = F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.floor(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 9) * (1 + (F.col("o_orderkey") % 4) * 7000))).cast("long")
    o = source(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return o.select("o_orderkey", "s", scalars.chunk_size(F.col("s")).alias("chunk_size"), scalars.chunk_count(F.col("s")).alias("chunks"), scalars.pool_size(F.col("s")).alias("pool"))


_ALL = "FROM folders f"


@query(""", p AS (SELECT folder_id, '/' || name AS path, 0 AS depth FROM folders f WHERE NOT EXISTS (SELECT 1 FROM folders u WHERE u.folder_id = f.parent_id)
    UNION ALL SELECT f.folder_id, p.path || '/' || f.name, p.depth + 1 FROM p JOIN folders f ON f.parent_id = p.folder_id) SELECT * FROM p""", "folders")
def absolute_paths(spark, d):
    return tree.absolute_paths(catalog(spark, d, "folders"))


@query(", s AS (SELECT folder_id, 0 AS depth FROM folders WHERE folder_id = 'r1' UNION ALL SELECT f.folder_id, s.depth + 1 FROM s JOIN folders f ON f.parent_id = s.folder_id) SELECT * FROM s", "folders")
def subtree_closure(spark, d):
    return tree.subtree(catalog(spark, d, "folders"), "r1")


@query(", b AS (SELECT folder_id AS leaf, folder_id, 0 AS up, name, parent_id FROM folders WHERE folder_id LIKE 'c%7' UNION ALL SELECT b.leaf, f.folder_id, b.up + 1, f.name, f.parent_id FROM b JOIN folders f ON f.folder_id = b.parent_id) SELECT leaf, folder_id, up, name FROM b", "folders")
def breadcrumbs(spark, d):
    f = catalog(spark, d, "folders")
    return tree.breadcrumbs(f, f.where("folder_id like 'c%7'").select("folder_id"))


_LINKS = "l AS (SELECT 'l' || p_partkey AS path, CASE WHEN p_partkey % 60 = 0 THEN 'file' || p_partkey WHEN p_partkey % 601 = 1 THEN 'l' || p_partkey ELSE 'l' || (p_partkey + 1) END AS target FROM part)"


@query(f"""WITH RECURSIVE {_LINKS}, r AS (SELECT path, target, 1 AS hops FROM l UNION ALL SELECT r.path, l.target, r.hops + 1 FROM r JOIN l ON l.path = r.target WHERE r.hops <= 40)
    SELECT path, CASE WHEN max(hops) > 40 THEN NULL ELSE arg_max(target, hops) END AS target, least(max(hops), 40) AS hops, CASE WHEN max(hops) > 40 THEN 'ELOOP' END AS error_code FROM r GROUP BY 1""")
def symlink_resolve(spark, d):
    return tree.resolve_links(_links(source(spark, d, "part")))


QUERIES["symlink_resolve_all"], ORACLE_SQL["symlink_resolve_all"] = symlink_resolve, ORACLE_SQL["symlink_resolve"]


def _links(part):
    return part.selectExpr("concat('l', p_partkey) AS path", "CASE WHEN p_partkey % 60 = 0 THEN concat('file', p_partkey) WHEN p_partkey % 601 = 1 THEN concat('l', p_partkey) ELSE concat('l', p_partkey + 1) END AS target")


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN regexp_extract(url, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(url, '^(.*)/[^/]*$', 1) END AS dir,
    rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS b64 FROM pages""")
def path_parts(spark, d):
    p = source(spark, d, "pages")
    return p.select("page_id", scalars.basename(F.col("url")).alias("base"), scalars.dirname(F.col("url")).alias("dir"), scalars.base64url(F.encode("url", "UTF-8")).alias("b64"))


@query()
def normalize_path(spark, d):
    p = F.concat(F.lit("/a//./"), F.regexp_replace("url", "example", ".."), F.when(F.col("page_id") % 3 == 0, "/../..").otherwise("/."))
    return source(spark, d, "pages").select("page_id", scalars.normalize(p).alias("path"))


@query("""SELECT file_id, regexp_replace(lower(regexp_replace(regexp_replace(file_name, '\\.[^.]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\-./]', ' ', 'g') || ' txt ' || replace(mime_type, '/', ' ') || CASE WHEN file_size < 1024 THEN ' tiny' WHEN file_size < 1048576 THEN ' small' ELSE ' medium' END || ' file' AS t,
    CASE WHEN mime_type LIKE 'image/%' THEN 'image' ELSE 'document' END AS kind, 'TXT' AS ext, CASE WHEN file_size < 1024 THEN file_size || ' B' ELSE printf('%.1f KB', floor(file_size * 10.0::DOUBLE / 1024 + 0.5) / 10) END AS label FROM files""", "files")
def embedding_text(spark, d):
    f = catalog(spark, d, "files")
    c = F.col
    return f.select("file_id", scalars.embedding_text(c("file_name"), c("mime_type"), c("file_size")).alias("t"), scalars.result_type(c("mime_type")).alias("kind"), scalars.extension(c("file_name")).alias("ext"), scalars.size_label(c("file_size")).alias("label"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(url), '[^a-z0-9\\s\\-_.]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2 AND length(w) < 40)"
_TOKENS = f"flatten(list_transform({_WORDS}, lambda w: [w] || CASE WHEN regexp_matches(w, '[-_.]') THEN list_filter(regexp_split_to_array(w, '[-_.]'), lambda p: length(p) > 1) ELSE [] END))"


@query(f"SELECT page_id, array_to_string({_TOKENS}, ' ') AS t FROM pages")
def tokenize(spark, d):
    return source(spark, d, "pages").select("page_id", F.array_join(scalars.tokens(F.col("url")), " ").alias("t"))


#: Code units of 16 bits, two for what is beyond the first plane.
_UNITS = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [(55296 + (unicode(c) - 65536) // 1024)::BIGINT, (56320 + (unicode(c) - 65536) % 1024)::BIGINT] ELSE [unicode(c)::BIGINT] END))"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, " + _UNITS + "), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT)"


@query(f"SELECT page_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (SELECT page_id, {_FNV.format(x='url')} AS h FROM pages)")
def fnv_hash(spark, d):
    return source(spark, d, "pages").select("page_id", scalars.fnv(F.col("url")).alias("h"))


QUERIES["fnv_hash_all"], ORACLE_SQL["fnv_hash_all"] = fnv_hash, ORACLE_SQL["fnv_hash"]


@query()
def inode(spark, d):
    return catalog(spark, d, "files").select("file_id", arrow.inode(F.col("file_id")).alias("ino"))


@query("SELECT id, '{\"a\":{\"x\":1},\"k\":' || json_extract(props, '$.k') || '}' AS m FROM audit_log", "audit_log")
def deep_merge(spark, d):
    return catalog(spark, d, "audit_log").select("id", arrow.deep_merge(F.lit('{"a":{"x":1,"y":2},"z":3}'), F.concat(F.lit('{"a":{"y":null},"z":null,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))).alias("m"))


@query("""SELECT event_id, CASE WHEN h = 200 THEN 200 WHEN a >= 100 THEN 416 ELSE 206 END AS status, CASE WHEN h <> 200 AND a < 100 THEN a END AS start, CASE WHEN h <> 200 AND a < 100 THEN CASE WHEN event_id % 3 = 0 THEN least(a + 10, 99) ELSE 99 END END AS "end"
    FROM (SELECT event_id, event_id % 130 AS a, CASE WHEN event_id % 3 = 2 THEN 200 ELSE 0 END AS h FROM events)""")
def parse_range(spark, d):
    a = F.col("event_id") % 130
    h = F.when(F.col("event_id") % 3 == 0, F.format_string("bytes=%d-%d", a, a + 10)).when(F.col("event_id") % 3 == 1, F.format_string("bytes=%d-", a)).otherwise(F.lit("bytes=1-2,4-5"))
    r = source(spark, d, "events").select("event_id", scalars.byte_range(h, F.lit(100).cast("long")).alias("r"))
    return r.select("event_id", "r.status", "r.start", "r.end")


@query("SELECT i AS n, CAST(least(60000 * pow(2, least(i, 16)), 21600000) AS BIGINT) AS ms FROM range(20) t(i)")
def backoff(spark, d):
    return spark.range(20).select(F.col("id").alias("n"), scalars.backoff(F.col("id")).alias("ms"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"


def _query_vector(spark, d):
    return source(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return search.top_k(source(spark, d, "embeddings"), _query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e WHERE label % 3 = 1 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark, d):
    return search.top_k(source(spark, d, "embeddings"), _query_vector(spark, d), 10, F.col("label") % 3 == 1).withColumn("score", F.round("score", 6))


@query(f"""WITH h AS (SELECT vec_id, label % 2 AS space, {_COS} AS s FROM embeddings e), t AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY s DESC, vec_id) AS rn FROM h),
    n AS (SELECT vec_id // 2 AS vec_id, space, s FROM t WHERE rn <= 40 AND s > 0), m AS (SELECT vec_id, space, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1 END AS f FROM n WINDOW w AS (PARTITION BY space)),
    b AS (SELECT vec_id, space, floor(f * 1000 + 0.5) / 1000 AS score, row_number() OVER (PARTITION BY vec_id ORDER BY floor(f * 1000 + 0.5) DESC, space) AS r FROM m)
    SELECT vec_id, space, score FROM b WHERE r = 1 ORDER BY score DESC, vec_id LIMIT 20""")
def search_fusion(spark, d):
    e, q = source(spark, d, "embeddings"), _query_vector(spark, d)
    of = lambda s: search.top_k(e, q, 40, F.col("label") % 2 == s).select(F.floor(F.col("vec_id") / 2).alias("vec_id"), F.lit(s).alias("space"), F.lit(s).alias("space_rank"), "score")
    return search.fused(of(0).union(of(1)), 20)


@query("SELECT label % 2 AS space, count(*) AS n, min(len(embedding))::BIGINT AS dimensions FROM embeddings GROUP BY 1")
def vector_stats(spark, d):
    return search.stats(source(spark, d, "embeddings"), F.col("label") % 2)


_FNV_T = "(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT " + _FNV.format(x="t") + " AS h))"


@query(f"""WITH w AS (SELECT page_id, w, ln(1 + count(*)) AS n FROM (SELECT page_id, unnest({_TOKENS}) AS w FROM pages) GROUP BY 1, 2), s AS (SELECT page_id, n, unnest([w, w || '_2', w || '_3']) AS t FROM w),
    h AS (SELECT page_id, n, {_FNV_T} AS h FROM s), b AS (SELECT page_id, abs(h) % 256 AS bucket, sum(CASE WHEN h > 0 THEN n ELSE -n END) AS v FROM h GROUP BY 1, 2)
    SELECT page_id, bucket, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY page_id)) > 0 THEN round(v / sqrt(sum(v * v) OVER (PARTITION BY page_id)), 6) + 0.0 ELSE 0 END AS weight FROM b""")
def hash_embed(spark, d):
    return search.embedded(source(spark, d, "pages"), "page_id", "url").withColumn("weight", F.round("weight", 6) + 0.0)


_LAST = "k AS (SELECT path_id, max(seq) AS c FROM audit_log WHERE kind = 'checkpoint' GROUP BY 1)"


@query(f", {_LAST} SELECT path_id, seq, kind FROM audit_log LEFT JOIN k USING (path_id) WHERE c IS NULL OR seq >= c", "audit_log")
def oplog_compact(spark, d):
    return folds.compacted(catalog(spark, d, "audit_log")).select("path_id", "seq", "kind")


@query(f", {_LAST} SELECT path_id, round(sum(value), 6) AS state, count(*) AS ops, max(seq) AS last_seq, arg_max(op, seq) AS last_op FROM audit_log LEFT JOIN k USING (path_id) WHERE c IS NULL OR seq >= c GROUP BY 1", "audit_log")
def oplog_replay(spark, d):
    return folds.replayed(catalog(spark, d, "audit_log")).withColumn("state", F.round("state", 6))


@query(f""", {_LAST}, e AS (SELECT max(ts) - 600000000 AS now FROM audit_log), t AS (SELECT path_id, max(ts) AS ckpt FROM audit_log WHERE kind = 'checkpoint' GROUP BY 1),
    n AS (SELECT path_id, count(*) AS n, min(ts) AS first FROM audit_log LEFT JOIN k USING (path_id) WHERE kind = 'op' AND (c IS NULL OR seq >= c) GROUP BY 1)
    SELECT path_id, n, coalesce(ckpt, first) AS since FROM n LEFT JOIN t USING (path_id), e WHERE n >= 8 OR (n > 0 AND now - coalesce(ckpt, first) >= 86400000)""", "audit_log")
def compaction_due(spark, d):
    log = catalog(spark, d, "audit_log")
    return folds.due_for_compaction(log, log.agg(F.max("ts")).first()[0] - 600_000_000, 8, 86_400_000)


@query(""", o AS (SELECT path_id, ts, row_number() OVER (PARTITION BY path_id ORDER BY ts) AS i FROM audit_log),
    b AS (SELECT path_id, ts, i, 2.0::DOUBLE - 1 AS tokens, 1 AS granted, 0 AS refused FROM o WHERE i = 1
    UNION ALL SELECT o.path_id, o.ts, o.i, CASE WHEN f >= 1 THEN f - 1 ELSE f END, b.granted + (f >= 1)::INT, b.refused + (f < 1)::INT FROM b JOIN o ON o.path_id = b.path_id AND o.i = b.i + 1, LATERAL (SELECT least(2.0::DOUBLE, b.tokens + (o.ts - b.ts) / 1000.0::DOUBLE * 0.0001::DOUBLE) AS f))
    SELECT path_id, arg_max(granted, i)::BIGINT AS granted, arg_max(refused, i)::BIGINT AS refused, round(arg_max(tokens, i), 6) AS tokens FROM b GROUP BY 1""", "audit_log")
def token_bucket(spark, d):
    return folds.token_bucket(catalog(spark, d, "audit_log"), "path_id", "ts", 0.0001, 2.0).withColumn("tokens", F.round("tokens", 6))


@query(""", o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i, CAST(value AS BIGINT) - 40 AS x FROM (SELECT *, floor(value) AS value FROM (SELECT path_id, seq, value FROM audit_log))),
    b AS (SELECT path_id, i, greatest(x, 0) AS used, greatest(x, 0) AS peak FROM o WHERE i = 1 UNION ALL SELECT o.path_id, o.i, greatest(b.used + x, 0), greatest(b.peak, b.used + x) FROM b JOIN o ON o.path_id = b.path_id AND o.i = b.i + 1)
    SELECT path_id, arg_max(used, i) AS used, max(peak) AS peak FROM b GROUP BY 1""".replace("SELECT *, floor(value) AS value FROM (SELECT path_id, seq, value FROM audit_log)", "SELECT path_id, seq, floor(value) AS value FROM audit_log"), "audit_log")
def usage_counter(spark, d):
    return folds.usage(catalog(spark, d, "audit_log").withColumn("delta", F.floor("value") - 40), "path_id", "seq", "delta")


@query(""", o AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS i, CAST(value AS DOUBLE) AS x, op <> 'error' AND seq % 9 <> 4 AS ok FROM audit_log),
    b AS (SELECT path_id, 0::BIGINT AS i, 4.0::DOUBLE AS cwnd, 32.0::DOUBLE AS ssthresh, NULL::DOUBLE AS srtt, 0.0::DOUBLE AS rttvar FROM (SELECT DISTINCT path_id FROM o)
    UNION ALL SELECT o.path_id, o.i, CASE WHEN NOT ok THEN greatest(cwnd / 2, 2) ELSE least(64, CASE WHEN cwnd < ssthresh THEN cwnd + 1 ELSE cwnd + 1 / cwnd END) END, CASE WHEN ok THEN ssthresh ELSE greatest(cwnd / 2, 2) END,
      CASE WHEN NOT ok THEN srtt WHEN srtt IS NULL THEN x ELSE 0.875::DOUBLE * srtt + 0.125::DOUBLE * x END, CASE WHEN NOT ok THEN rttvar WHEN srtt IS NULL THEN x / 2 ELSE 0.75::DOUBLE * rttvar + 0.25::DOUBLE * abs(srtt - x) END FROM b JOIN o ON o.path_id = b.path_id AND o.i = b.i + 1)
    SELECT path_id, round(arg_max(cwnd, i), 6) AS cwnd, round(arg_max(ssthresh, i), 6) AS ssthresh, round(arg_max(srtt, i), 6) AS srtt, round(arg_max(rttvar, i), 6) AS rttvar, round(CASE WHEN arg_max(srtt, i) IS NULL THEN 1000 ELSE greatest(1000, arg_max(srtt + 4 * rttvar, i)) END, 6) AS rto FROM b GROUP BY 1""", "audit_log")
def aimd_trace(spark, d):
    rows = catalog(spark, d, "audit_log").withColumn("ok", (F.col("op") != "error") & (F.col("seq") % 9 != 4))
    return folds.aimd(rows, "path_id", "seq", "value", "ok").select("path_id", *(F.round(c, 6).alias(c) for c in ("cwnd", "ssthresh", "srtt", "rttvar", "rto")))


_INTENTS = "i AS (SELECT id, CASE seq % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_flight' ELSE 'cleaned' END AS state, seq % 5 AS attempts, seq AS generation, seq * 10000 AS next_attempt_at, seq * 20000 AS updated_at FROM audit_log)"


@query(f""", {_INTENTS} SELECT id, CASE WHEN state = 'pending' AND next_attempt_at <= 400000 THEN 'in_flight' WHEN state = 'in_flight' AND updated_at + 300000 <= 400000 THEN 'pending' ELSE state END AS new_state,
    attempts + (state = 'pending' AND next_attempt_at <= 400000)::INT AS new_attempts, generation + ((state = 'pending' AND next_attempt_at <= 400000) OR (state = 'in_flight' AND updated_at + 300000 <= 400000))::INT AS new_generation FROM i WHERE state <> 'cleaned'""", "audit_log")
def outbox_transition(spark, d):
    s = F.col("seq")
    rows = catalog(spark, d, "audit_log").select("id", F.when(s % 3 == 0, "pending").when(s % 3 == 1, "in_flight").otherwise("cleaned").alias("state"), (s % 5).alias("attempts"), s.alias("generation"), (s * 10_000).alias("next_attempt_at"), (s * 20_000).alias("updated_at"))
    return folds.outbox(rows, 400_000).select("id", "new_state", "new_attempts", "new_generation")


@query("SELECT id, before, op FROM (SELECT *, lag(op) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM audit_log) WHERE before IS NOT NULL AND NOT ((before = 'view' AND op IN ('click', 'view')) OR (before = 'click' AND op = 'purchase'))", "audit_log")
def fence_transitions(spark, d):
    return folds.illegal_transitions(catalog(spark, d, "audit_log"), "path_id", "seq", "op", {"view": {"click", "view"}, "click": {"purchase"}}).select("id", "before", "op")


@query("""SELECT parent_id, count(*) AS revision FROM (SELECT coalesce(parent_id, '') AS parent_id FROM files
    UNION ALL SELECT 'src' || CAST(file_id AS BIGINT) % 7 FROM files WHERE CAST(file_id AS BIGINT) % 3 = 0 AND coalesce(parent_id, '') <> 'src' || CAST(file_id AS BIGINT) % 7) GROUP BY 1""", "files")
def folder_revision(spark, d):
    """Every file is changed once, and every third by a move, which bumps two folders unless it stays."""
    n = F.col("file_id").cast("long")
    ops = catalog(spark, d, "files").select("parent_id", F.when(n % 3 == 0, "move").otherwise("write").alias("op"), F.concat(F.lit("src"), n % 7).alias("new_parent_id"))
    return folds.revisions(ops)


@query(", r AS (SELECT *, CASE WHEN updated_at % 2000 = 0 THEN file_hash END AS metadata FROM files) SELECT file_id, coalesce(metadata, lead(metadata) OVER w) AS metadata, row_number() OVER w = 1 AS live FROM r WINDOW w AS (PARTITION BY user_id, coalesce(parent_id, ''), mime_type ORDER BY updated_at DESC, file_id DESC)", "files")
def commit_rename_supersede(spark, d):
    f = catalog(spark, d, "files").withColumn("file_name", F.col("mime_type")).withColumn("metadata", F.when(F.col("updated_at") % 2000 == 0, F.col("file_hash")))
    return mutations.published(f).select("file_id", "metadata", "live")


@query("""SELECT file_id AS id, CASE WHEN status = 'deleted' OR row_number() OVER (PARTITION BY user_id, coalesce(parent_id, ''), mime_type, status = 'deleted' ORDER BY updated_at DESC, file_id DESC) = 1 THEN 'keep' ELSE 'drop' END AS action FROM files""", "files")
def dedupe_paths(spark, d):
    f = catalog(spark, d, "files").select(F.col("file_id").alias("id"), "user_id", "parent_id", F.col("mime_type").alias("name"), "updated_at", "status")
    return mutations.deduplicated(f).select("id", "action")


@query("""SELECT folder_id AS id, CASE WHEN row_number() OVER (PARTITION BY length(folder_id) % 2, coalesce(parent_id, ''), length(name) ORDER BY length(folder_id) DESC, folder_id DESC) = 1 THEN 'keep'
    WHEN EXISTS (SELECT 1 FROM folders c WHERE c.parent_id = f.folder_id) OR EXISTS (SELECT 1 FROM orders o WHERE 'c' || o.o_custkey = f.folder_id AND o.o_orderstatus <> 'P') THEN 'skip' ELSE 'drop' END AS action FROM folders f""", "folders")
def dedupe_folders(spark, d):
    """Folders of one parent and length of name; those with subfolders, or live files (orders), are skipped."""
    f = catalog(spark, d, "folders")
    rows = f.select(F.col("folder_id").alias("id"), F.length("folder_id").alias("n"), "parent_id", F.length("name").cast("string").alias("name"), F.length("folder_id").alias("updated_at")).withColumn("user_id", F.col("n") % 2)
    files = source(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("c"), "o_custkey").alias("parent_id"))
    return mutations.deduplicated(rows, f.where("parent_id IS NOT NULL").select("parent_id").union(files)).select("id", "action")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 4 = 0")
def upsert_vectors(spark, d):
    e = source(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    return mutations.upsert(e, new.union(new.select(F.col("vec_id") + 1_000_000, "label")), ["vec_id"])


@query("SELECT path_id, tag FROM file_tags UNION SELECT path_id, 'en' FROM file_tags", "file_tags")
def insert_or_ignore(spark, d):
    t = catalog(spark, d, "file_tags").distinct()
    return mutations.insert_or_ignore(t, t.select("path_id", F.lit("en").alias("tag")), ["path_id", "tag"])


@query("SELECT path_id, tag FROM file_tags UNION SELECT lpad(CAST(CAST(path_id AS BIGINT) + 5 AS VARCHAR), 12, '0'), tag FROM file_tags WHERE CAST(path_id AS BIGINT) % 10 = 0", "file_tags")
def copy_tags(spark, d):
    t = catalog(spark, d, "file_tags").distinct()
    pairs = t.select(F.col("path_id").alias("source")).distinct().where(F.col("source").cast("long") % 10 == 0)
    return mutations.copied_tags(t, pairs.withColumn("copy", F.lpad((F.col("source").cast("long") + 5).cast("string"), 12, "0")))


@query(", s AS (SELECT folder_id FROM folders WHERE folder_id = 'r1' UNION ALL SELECT f.folder_id FROM s JOIN folders f ON f.parent_id = s.folder_id) SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.folder_id = 'c' || o_custkey)", "folders")
def remove_recursive(spark, d):
    files = source(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("parent_id"))
    return mutations.removed(files, tree.subtree(catalog(spark, d, "folders"), "r1")).select("o_orderkey")


@query("""SELECT file_id, parent_id, name, row_number() OVER (PARTITION BY user_id, coalesce(parent_id, ''), name ORDER BY moved DESC, updated_at DESC, file_id DESC) > 1 AS overwritten FROM
    (SELECT file_id, user_id, updated_at, CAST(file_id AS BIGINT) % 9 = 0 AS moved, CASE WHEN CAST(file_id AS BIGINT) % 9 = 0 THEN 'src5' ELSE parent_id END AS parent_id, CASE WHEN CAST(file_id AS BIGINT) % 9 = 0 THEN 'doc_5.txt' ELSE file_name END AS name FROM files)""", "files")
def rename_overwrite(spark, d):
    f = catalog(spark, d, "files")
    moves = f.where(F.col("file_id").cast("long") % 9 == 0).select("file_id", F.lit("src5").alias("parent_id"), F.lit("doc_5.txt").alias("file_name"))
    return mutations.renamed(f, moves).select("file_id", "parent_id", F.col("file_name").alias("name"), "overwritten")


@query("""SELECT file_id, CASE WHEN a AND head_version_id IS NOT DISTINCT FROM e THEN 'v2' ELSE head_version_id END AS head_version_id, CASE WHEN a THEN head_version_id IS NOT DISTINCT FROM e END AS patched
    FROM (SELECT file_id, head_version_id, CAST(file_id AS BIGINT) % 2 = 0 AS a, CASE WHEN CAST(file_id AS BIGINT) % 4 = 0 THEN 'v1' END AS e FROM files)""", "files")
def compare_and_set(spark, d):
    f = catalog(spark, d, "files")
    n = F.col("file_id").cast("long")
    return mutations.compare_and_set(f, f.where(n % 2 == 0).select("file_id", F.when(n % 4 == 0, "v1").alias("expected"), F.lit("v2").alias("new")))


@query("SELECT path_id, version_id, size, deleted FROM versions_history UNION ALL SELECT DISTINCT path_id, 'gone', 0, true FROM versions_history WHERE size > 900", "versions_history")
def unlink(spark, d):
    v = catalog(spark, d, "versions_history")
    return mutations.unlinked(v, v.where("size > 900").select("path_id").distinct(), 77, "gone").select("path_id", "version_id", "size", "deleted")


@query("SELECT path_id, version_id FROM versions_history WHERE path_id NOT IN (SELECT path_id FROM versions_history WHERE size > 900)", "versions_history")
def purge(spark, d):
    v = catalog(spark, d, "versions_history")
    return mutations.purged(v, v.where("size > 900").select("path_id").distinct()).select("path_id", "version_id")


@query("SELECT file_id FROM files WHERE status = 'uploading' AND updated_at < 9000000 - 3600000 AND ((file_size % 3 > 0 AND file_size % 4 > 0) OR (file_size % 3 = 0 AND file_size < 600) OR (file_size % 4 = 0 AND file_size < 700))", "files")
def orphan_uploads(spark, d):
    f = catalog(spark, d, "files")
    until = lambda n: F.when(F.col("file_size") < n, 8_000_000).otherwise(10_000_000)
    w = f.where("file_size % 3 = 0").select(F.col("file_id").alias("tmp_id"), until(600).alias("expires_at"))
    u = f.where("file_size % 4 = 0").select(F.col("file_id").alias("upload_id"), until(700).alias("expires_at"))
    return mutations.orphaned_uploads(f, w, u, 9_000_000)


@query("SELECT least((SELECT min(updated_at) + 50 FROM files), (SELECT min(mtime_ms) + 9 FROM versions_history), (SELECT min(ts) FROM audit_log)) AS at", "files", "versions_history", "audit_log")
def next_deadline(spark, d):
    f, v, a = (catalog(spark, d, x) for x in ("files", "versions_history", "audit_log"))
    return mutations.next_deadline(f.select(F.col("updated_at") + 50), v.select(F.col("mtime_ms") + 9), a.select("ts"))


@query("SELECT status, count(*) AS n FROM files GROUP BY 1", "files")
def snapshot_round_trip(spark, d):
    """A snapshot partitioned by user, written to the shared folder and read back."""
    path = write_snapshot(catalog(spark, d, "files"), scratch_path(spark, "snapshots"), ["user_id"])
    return reporting.duplicates(spark.read.parquet(path).select("status"), "status")


