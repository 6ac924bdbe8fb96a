"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A batch of documents is first
reduced to one row per digest (map-side combined, so a text that fills a third of the batch costs one row per
task), the digests that the index lacks are found with a sort-merge anti-join in which the index side is not shuffled,
and those are appended as one sorted file per bucket. Spark sorts a bucket of several files again; with
``spark.sql.legacy.bucketedTableScan.outputOrdering`` on, a compacted index, of one file per bucket, is not sorted either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import materialize, scratch_dir, shuffle_partitions


def text_digest(text: str = "text"):
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """Digests seen so far, at ``path``: (digest, keep_id, group_size, batch), bucketed and sorted by digest.

    An index outlives its session: opening the same path with the same bucket count registers it again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def compact(self, path: str) -> DigestIndex:
        """The same index at a new path, with one file per bucket: batches each add one. This one stays as it is."""
        found = DigestIndex(self.spark, path, self.buckets)
        found._append(self.spark.read.schema(self.rows().schema).parquet(self.path))  # as plain files, so that they are dealt anew
        return found

    def close(self) -> None:
        """Take the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and within themselves; append what is new.

        One row per input row: ``id_col``, digest, keep_id (row that stays for this text), group_size (rows of the
        batch that brought the text), kept. Within a batch the largest id stays; a text that an earlier batch
        brought keeps that batch's row and drops all new ones. A null text counts as empty; null ids lose against
        any other; rows that repeat an id and text are one document and get the same verdict; other columns are
        ignored. An empty input gives no rows and leaves the index as it is.
        """
        docs = materialize(docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(text_col).alias("digest")), "digests")
        groups = docs.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.withColumn("batch", F.lit(uuid.uuid4().hex)))
        present = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
        resolved = materialize(present.join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", "_n"), "resolved")
        # texts with more rows than a quarter of an even task are broadcast: there are at most four for each task
        most = max(100, docs.count() // (4 * shuffle_partitions(self.spark)))
        hot, rest = resolved.where(F.col("_n") > most), resolved.where(F.col("_n") <= most)
        found = docs.join(F.broadcast(hot), "digest").unionByName(
            docs.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest")
        )
        return found.select(F.col("_id").alias(id_col), "digest", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """``DigestIndex.add`` on ``index``, or on a new empty index in the shared folder."""
    if index is not None:
        return index.add(docs, id_col, text_col)
    spark = docs.sparkSession
    own = DigestIndex(spark, f"{scratch_dir(spark)}/digest_index", shuffle_partitions(spark))
    found = own.add(docs, id_col, text_col)
    own.close()
    return found


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
