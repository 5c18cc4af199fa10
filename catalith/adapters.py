"""Catalog tables derived from the driver's tables, for Spark and, as text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Definitions in SQL that both engines read, but for the few functions in DIALECT.
TABLES = {
    "files": """SELECT lpad(CAST(doc_id AS {string}), 12, '0') AS file_id, concat('u', doc_id % 4) AS user_id,
        CASE source WHEN 'src0' THEN NULL WHEN 'src1' THEN '' ELSE source END AS parent_id, concat('doc_', doc_id, '.txt') AS file_name,
        CAST({bytes} AS BIGINT) AS file_size, {sha} AS file_hash, CASE WHEN doc_id % 5 = 0 THEN 'image/png' ELSE concat('text/', lang) END AS mime_type,
        CASE WHEN doc_id % 17 = 0 THEN 'uploading' WHEN doc_id % 23 = 0 THEN 'deleted' ELSE 'complete' END AS status,
        doc_id * 60000 AS created_at, ((doc_id * 7919) % 1000) * 1000 AS updated_at, coalesce(quality = 0, false) AS archived,
        CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'v1' END AS head_version_id
        FROM {documents} LEFT JOIN {labels} USING (doc_id)""",
    "file_versions": """SELECT lpad(CAST(doc_id AS {string}), 12, '0') AS path_id, 'v1' AS version_id, coalesce(toxic = 1, false) AS deleted,
        CAST({bytes} AS BIGINT) + 7 AS size, doc_id * 1000 AS mtime_ms FROM {documents} LEFT JOIN {labels} USING (doc_id)""",
    "file_tags": """SELECT lpad(CAST(doc_id AS {string}), 12, '0') AS path_id, lang AS tag FROM {documents}
        UNION ALL SELECT lpad(CAST(doc_id AS {string}), 12, '0'), source FROM {documents}
        UNION ALL SELECT lpad(CAST(doc_id AS {string}), 12, '0'), concat('quality:', quality) FROM {labels} WHERE quality IS NOT NULL""",
    "versions_history": """SELECT concat('c', conv_id) AS path_id, lpad(CAST(turn AS {string}), 6, '0') AS version_id, (turn - turn % 2) * 1000 AS mtime_ms,
        CAST({bytes} AS BIGINT) AS size, role = 'system' OR turn % 5 = 4 AS deleted, role = 'assistant' AS user_visible FROM {conversations}""",
    "folders": """SELECT concat('r', r_regionkey) AS folder_id, CAST(NULL AS {string}) AS parent_id, r_name AS name FROM {region}
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM {nation}
        UNION ALL SELECT concat('c', c_custkey), CASE WHEN c_custkey % 97 = 0 THEN 'gone' ELSE concat('n', c_nationkey) END, c_name FROM {customer}""",
    "file_chunks": """SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS chunk_index,
        {sha_part} AS chunk_hash, CAST(l_quantity AS BIGINT) AS chunk_size, l_suppkey % 32 AS shard_index FROM {lineitem}""",
    "audit_log": """SELECT concat('a', event_id) AS id, event_type AS op, concat('p', user_id) AS actor, {millis} AS ts, user_id AS path_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'purchase' THEN 'checkpoint' ELSE 'op' END AS kind,
        value, props FROM {events}""",
}
#: Definitions that only Spark reads: the same rows, with the window over the column that is put out, so that Spark knows how they are dealt and carries the key once, and below what is derived, so that a part's key moves and not its hash.
SPARK_TABLES = {
    "file_chunks": """SELECT file_id, chunk_index, {sha_part} AS chunk_hash, CAST(l_quantity AS BIGINT) AS chunk_size, l_suppkey % 32 AS shard_index FROM (
        SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS chunk_index, l_partkey, l_quantity, l_suppkey
        FROM (SELECT *, l_orderkey AS file_id FROM {lineitem}))""",
}
DIALECT = {
    "spark": {"string": "STRING", "bytes": "octet_length(text)", "sha": "sha2(text, 256)", "sha_part": "sha2(CAST(l_partkey AS STRING), 256)", "millis": "unix_millis(ts)"},
    "duckdb": {"string": "VARCHAR", "bytes": "strlen(text)", "sha": "sha256(text)", "sha_part": "sha256(CAST(l_partkey AS VARCHAR))", "millis": "epoch_us(ts) // 1000"},
}
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table over the driver's tables; events' local timestamps are read as UTC."""
    text, used = SPARK_TABLES.get(name, TABLES[name]), {}
    for s in SOURCES:
        if f"{{{s}}}" in text:
            df = source(spark, sf_dir, s)
            if s == "events":
                df = df.withColumn("ts", df["ts"].cast("timestamp"))
            used[s] = df
    for k, v in DIALECT["spark"].items():
        text = text.replace(f"{{{k}}}", v)
    return spark.sql(text, **used)


def duckdb_with(*names: str) -> str:
    """The definitions of catalog tables as common table expressions."""
    fill = DIALECT["duckdb"] | {s: s for s in SOURCES}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n].format(**fill)})" for n in names)
