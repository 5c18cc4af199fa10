"""The registered queries of this subpackage: thin digests over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, jaccard_join, pii_surrogates, quality_rank, quality_rules, secret_scan, url_filter, warc_index
from .common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.judge(table(spark, sf_dir, "documents"))
    return q.select("doc_id", *(F.col("quality")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _rule_sql() -> str:
    """The threshold table as SQL over the measures."""
    parts = []
    for r in quality_rules.RULES:
        parts += [f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)
    return " AND ".join(parts)


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM g),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality_rules.STOP_FORMS)}], x))) AS n_stop
      FROM w LEFT JOIN p USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rule_sql()} AS kept FROM r
"""

def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)),
n AS (SELECT d.rid, doc_id, count(sh) AS n FROM d LEFT JOIN s USING (rid) GROUP BY 1, 2),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT u.doc_id AS a, v.doc_id AS b FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, n AS n_shingles, m AS component_id FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id
"""

def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    spans = F.col("secrets")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    base = F.sha2(secret_scan.listed(of(*secret_scan.BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secret_scan.listed(spans).alias("spans"))


def tokens_digest(docs: DataFrame) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_digest(table(spark, sf_dir, "documents"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, by the key in ``spark.catalith.pii.key``."""
    key = spark.conf.get("spark.catalith.pii.key", "catalith")
    return pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "text", F.map_entries("entities").alias("entities"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_index.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM p LEFT JOIN m USING (d)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_warc_index": op2_warc_index,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rank": op4_quality_rank,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_secret_scan": op7_secret_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_bpe": op9_bpe,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_index": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_jaccard_join": OP8_SQL,
}
