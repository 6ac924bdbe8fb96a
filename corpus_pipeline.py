"""Corpus preparation: keep good text, drop exact and near copies, pack what stays into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, text_digest
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_quality
from tidemark.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile of trusted text."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat that too, one."""
    digest, own = _unused(docs, 2)
    kept = exact_dedup(docs).where("kept").select(F.col("digest").alias(digest), _id().alias(own)).distinct()
    rows = docs.withColumns({digest: text_digest(), own: _id()}).join(kept, [digest, own], "left_semi")
    return rows.dropDuplicates([digest, own]).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id; rows that share an id stay together."""
    (own,) = _unused(docs, 1)
    found = jaccard_components(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(_id().alias(own)).distinct()
    return docs.withColumn(own, _id()).join(kept, own, "left_semi").select(docs.columns)


def _id() -> Column:
    """doc_id with a number of its own for null."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _unused(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return [c for c in (f"_key{i}" for i in range(len(taken) + n)) if c not in taken][:n]


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: A perplexity model and a packing have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
