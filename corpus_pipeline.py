"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last give the columns of ``documents``.  Rows without a text
fail the quality rules.  Documents that share an id count as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import decontaminate, jaccard_join, quality_rules, secret_scan
from catalith.llm.common import stored, table
from catalith.llm.queries import tokens_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id; documents without an id stay."""
    copies = jaccard_join.link(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind, and ``n_chars`` of what is left."""
    changed = secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return tokens_digest(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The decisions of near duplicates, decontamination and tokens have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
