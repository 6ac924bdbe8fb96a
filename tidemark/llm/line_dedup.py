"""Line deduplication against levelled sorted runs of line hashes.

A run is a Parquet table of (a, b, docs): the 128-bit hash of a line's key and the number of documents that brought it,
bucketed and sorted by the hash. A batch of documents is reduced to one row a key (combined on the map side, so a line
that stands in every document costs one row a task), merge-anti-joined with the runs for the keys that are settled, that
is, known to be in ``min_docs`` documents, and what is left becomes a run of level 0. As soon as a level holds ``fanout``
runs they are merged into one run of the next level, so a key is rewritten once a level and a batch meets at most
``fanout - 1`` runs of each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import materialize, scratch_dir, shuffle_partitions

_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_hash(line: bytes) -> bytes:
    """128-bit hash of the line's key: ASCII white space stripped at both ends, A-Z lower-cased. Empty for an empty key."""
    key = line.strip(_BLANK).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def _row_key(id_col: str, text_col: str) -> Column:
    """What a document is asked for by. Documents that share it share answers, which are the same for each line anyway."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes = [], []
        for text in batch.column(1).to_pylist():
            own = {line_hash(line) for line in text.split(b"\n")} - {b""}
            marks.extend(own)
            sizes.append(len(own))
        halves = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
        doc = np.repeat(batch.column(0).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["d", "a", "b"])


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, a, b): the distinct hashes of each document's lines; d is a hash of id and text."""
    return docs.select(_row_key(id_col, text_col).alias("d"), _text(text_col).alias("t")).mapInArrow(_explode, "d long, a long, b long")


class LineRuns:
    """Line hashes of all batches so far, in levelled runs below ``path``.

    A log beside the runs has one row for each: its name, level, and the runs it replaces. A run is entered once it is
    written in full, so a job that dies leaves the index as it was; opening the path again finds the same runs.
    """

    _LOG = "run string, level int, replaces array<string>"

    def __init__(self, spark: SparkSession, path: str, buckets: int, min_docs: int = 10, fanout: int = 3):
        self.spark, self.path, self.buckets, self.min_docs, self.fanout = spark, path, buckets, min_docs, fanout
        spark.createDataFrame([], self._LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(self._LOG).parquet(f"{self.path}/log")

    def live(self) -> list[tuple[str, int]]:
        """(run, level) of the runs that no other one replaces: at most ``fanout - 1`` for each level."""
        gone = self._log().select(F.explode("replaces").alias("run"))
        return sorted((r["run"], r["level"]) for r in self._log().join(gone, "run", "left_anti").collect())

    def _name(self, run: str) -> str:
        return "line_run_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.path}/{run}").hex

    def _table(self, run: str) -> str:
        name = self._name(run)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (a BIGINT, b BIGINT, docs BIGINT) USING parquet "
            f"CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return name

    def rows(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _write(self, rows: DataFrame, level: int, replaces: list[str]) -> None:
        run = uuid.uuid4().hex
        dealt = rows.select("a", "b", "docs").repartition(self.buckets, "a", "b")
        dealt.write.mode("append").format("parquet").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(self._table(run))
        self.spark.createDataFrame([(run, level, replaces)], self._LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _sum(self, runs: list[str]) -> DataFrame:
        # as plain files: a union of bucketed tables is not dealt anew for the sum, though their buckets lie in partitions of their own
        both = self.spark.read.schema("a long, b long, docs long").parquet(*(f"{self.path}/{run}" for run in runs))
        return both.groupBy("a", "b").agg(F.sum("docs").alias("docs"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Count the lines of a batch: merge-anti-join with the runs' settled keys, a run of its own, merges where due."""
        counts = line_hashes(docs, id_col, text_col).groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
        for run, _ in self.live():
            settled = self.rows(run).where(F.col("docs") >= self.min_docs).select("a", "b")
            counts = counts.join(settled.hint("merge"), ["a", "b"], "left_anti")
        self._write(counts, 0, [])
        level = 0
        while len(full := [run for run, at in self.live() if at == level]) >= self.fanout:
            self._write(self._sum(full), level + 1, full)
            level += 1

    def frequent(self) -> DataFrame:
        """(a, b) of the lines in at least ``min_docs`` documents of all batches."""
        runs = [run for run, _ in self.live()]
        if not runs:
            return self.spark.createDataFrame([], "a long, b long")
        return self._sum(runs).where(F.col("docs") >= self.min_docs).select("a", "b")

    def close(self) -> None:
        """Take the runs' names out of the catalog; the files stay."""
        for row in self._log().select("run").collect():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(row['run'])}")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, marks = batch.columns
        marks = pa.array(marks)
        ends = np.cumsum([0, *marks.value_lengths().fill_null(0).to_pylist()])
        flat = marks.flatten()
        raw = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype("<i8").tobytes() if len(flat) else b""
        out = []
        for k, text in enumerate(texts.to_pylist()):
            lines = text.split(b"\n")
            drop = {raw[i : i + 16] for i in range(16 * ends[k], 16 * ends[k + 1], 16)}
            kept = [line for line in lines if line_hash(line) not in drop] if drop else lines
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        cols = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:], strict=True))], schema=_OUT)


def drop_lines(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose hash is in ``keys``: (doc_id, n_lines before, n_dropped, kept as UTF-8).

    Documents ask for their own lines only; a line that is in very many documents is left to the skew join. What a
    document gets back is no longer than itself.
    """
    asked = line_hashes(docs, id_col, text_col).join(keys.hint("merge"), ["a", "b"])
    found = asked.groupBy("d").agg(F.collect_set(F.struct("a", "b")).alias("_drop"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("_t"), _row_key(id_col, text_col).alias("d"))
    return docs.join(found.hint("merge"), "d", "left").select("doc_id", "_t", "_drop").mapInArrow(_drop, "doc_id long, n_lines long, n_dropped long, kept binary")


def line_dedup(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines in at least ``min_docs`` documents lose all their occurrences; one row per document, as ``drop_lines`` gives.

    The documents enter an index of their own in ``batches`` by a hash of their ids. A null or empty text is one
    empty line; lines without a key are never dropped; a text that loses all its lines is empty. Every row is a document
    of its own, also if it repeats an id and a text; null ids stay null. Other columns are ignored, whatever their names. An
    empty input gives no rows.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, f"{scratch_dir(spark)}/line_runs", shuffle_partitions(spark), min_docs, fanout)
    for k in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k), id_col, text_col)
    # as a table, so that both sides of the join are plain exchanges and the skew join may split a line of very many documents
    frequent = materialize(runs.frequent(), "frequent")
    found = drop_lines(docs, frequent, id_col, text_col)
    runs.close()
    return found


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY row
"""
