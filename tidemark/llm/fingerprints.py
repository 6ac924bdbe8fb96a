"""Quartile bucket digests: locality-sensitive fingerprints of whole documents.

A text's UTF-8 byte triplets are hashed into buckets; each bucket is encoded as the quartile its count falls in, and
the length and the quartile ratios go before them. Two fingerprints are compared by a bounded sum of differences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import shuffle_partitions

BUCKETS = 256
#: What two unrelated texts differ by on average in their buckets: quartiles drawn alike, three apart counting as six.
UNRELATED = BUCKETS * (0.375 * 1 + 0.25 * 2 + 0.125 * 6)
_STEP = np.array([0, 1, 2, 6])
_PAIR = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))
#: Difference of two bytes that hold four quartiles each.
_BYTE = np.zeros((256, 256), dtype=np.int32)
for _shift in (0, 2, 4, 6):
    _q = (np.arange(256) >> _shift) & 3
    _BYTE += _STEP[_PAIR[np.ix_(_q, _q)]].astype(np.int32)


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed triplets of neighbouring bytes, and of bytes with one between, per bucket."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(buckets, dtype=np.int64)
    for salt, (i, j) in enumerate(((1, 2), (1, 3), (2, 4))):
        if len(b) > j:
            m = len(b) - j
            v = b[:m] | (b[i : i + m] << np.uint32(8)) | (b[j : j + m] << np.uint32(16)) | np.uint32(salt << 24)
            v *= np.uint32(2654435761)
            counts += np.bincount((v >> np.uint32(15)) % np.uint32(buckets), minlength=buckets)
    return counts


def fingerprint(text: str | None) -> str:
    """Hex digest: length (2 digits), quartile ratios (1 + 1 digits), buckets (2 bits each). Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = [min(15, 16 * q // q3) if q3 else 0 for q in (q1, q2)]
    body = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (body[:, 0] | body[:, 1] << 2 | body[:, 2] << 4 | body[:, 3] << 6).astype(np.uint8)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}" + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal fingerprints; header steps beyond one count twelvefold, quartiles three apart count six."""
    if a == b:
        return 0
    gap = abs(int(a[:2], 16) - int(b[:2], 16))
    score = gap if gap <= 1 else 2 * gap
    for i in (2, 3):
        gap = abs(int(a[i], 16) - int(b[i], 16))
        score += gap if gap <= 1 else 3 * (gap - 1)
    x, y = (np.frombuffer(bytes.fromhex(f[4:]), dtype=np.uint8) for f in (a, b))
    return score + int(_BYTE[x, y].sum())


def likeness(a: str, b: str, bound: float = UNRELATED) -> float:
    """1 for equal fingerprints, falling to 0 where the difference reaches ``bound``."""
    return 1.0 - min(difference(a, b), bound) / bound


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows laid out so that each task can walk its documents in id order and see the next one.

    Ids are cut into runs by approximate quantiles. Each run also gets, as a ghost row, the first document of the
    next run (the last run gets the very first), so texts are shuffled once. Columns: _run, _ghost, id, text;
    partitioned by run, sorted by run, ghost, id, text.
    """
    spark = docs.sparkSession
    runs = 8 * shuffle_partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rank = F.coalesce(F.col("_id"), F.lit(-(1 << 63))).cast("double")
    cuts = docs.agg(F.percentile_approx(rank, [i / runs for i in range(1, runs)], 4 * runs).alias("q")).first()["q"] or []
    edges = [-math.inf, *(sorted({*cuts}) or [0.0]), math.inf]
    docs = Bucketizer(splits=edges, inputCol="_rank", outputCol="_b").transform(docs.withColumn("_rank", rank))
    docs = docs.select("_id", "_text", F.col("_b").cast("int").alias("_run"))
    # one small row per run; structs, since a plain minimum would pass over null ids
    first = sorted((r["_run"], r["_first"]["_id"]) for r in docs.groupBy("_run").agg(F.min(F.struct("_id")).alias("_first")).collect())
    ghosts = [(at, own, first[k - 1][0]) for k, (own, at) in enumerate(first)]
    small = spark.createDataFrame(ghosts, "_id long, _run int, _before int")
    joined = docs.join(F.broadcast(small), docs["_id"].eqNullSafe(small["_id"]) & (docs["_run"] == small["_run"]), "left")
    own = F.struct(docs["_run"].alias("_run"), F.lit(0).alias("_ghost"))
    ghost = F.struct(F.col("_before").alias("_run"), F.lit(1).alias("_ghost"))
    laid = joined.select(
        docs["_id"], docs["_text"], F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("_at")
    )
    return (
        laid.select("_at._run", "_at._ghost", "_id", "_text")
        .repartition(shuffle_partitions(spark), "_run")
        .sortWithinPartitions("_run", "_ghost", F.col("_id").asc_nulls_first(), "_text")
    )


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = None  # the document that still waits for its next one: run, id, text, fingerprint

    def close(text: str, mark: str) -> None:
        _, doc_id, own, own_mark = held
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half]
        edited_mark = fingerprint(edited)
        out.append((
            doc_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, edited_mark,
            likeness(own_mark, edited_mark), likeness(own_mark, mark),
        ))

    for batch in batches:
        for run, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None and ghost:
                continue  # further rows that share the ghost's id
            mark = fingerprint(text)
            if held is not None:
                close(text, mark)
            held = None if ghost else (run, doc_id, text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
            out = []


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document, of its half-edited text, and its likeness to both that and the next document.

    The edited text has the last half of the code points replaced by the first ones of the next document in id
    order. Null texts count as empty; null ids come first; rows that repeat an id follow each other in text order;
    a lone document is its own next one. An empty input gives no rows.
    """
    return with_next(docs, id_col, text_col).mapInArrow(
        _walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
