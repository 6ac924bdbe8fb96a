"""Balanced shards by sampled splitters.

Records are ordered by a hash of their text (equal texts lie together) and cut into shards of near-equal bytes.
A size-weighted sample of the keys gives quantile splitters; records are range-partitioned by them; ranges that
came out too full, such as a text with very many copies, are subdivided. Exact prefix sums, first over the ranges
and then inside each, place every record. Only the splitters and one row per range are ever gathered.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import materialize


def sampled_splitters(keyed: DataFrame, ranges: int, per_range: int, weight_sum: float) -> list[float]:
    """Quantile boundaries of a weighted sample of ``_k``; a key that fills several ranges gets one of its own.

    Expects columns _id, _k (double) and _w. The sample has about ``ranges * per_range`` rows; a row is drawn with a
    probability that follows its weight, decided by a hash, so that the same rows give the same splitters.
    """
    rate = ranges * per_range / weight_sum if weight_sum else 0.0
    u = F.pmod(F.xxhash64("_id", "_k", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = keyed.where(u < 1 - F.exp(-F.col("_w") * rate))
    cuts = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile_approx("_k", cuts, 20 * ranges).alias("q")).first()["q"] or []
    repeated = {a for a, b in zip(found, found[1:]) if a == b}
    return sorted({*found, *(math.nextafter(x, math.inf) for x in repeated)})


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    rows_per_range: int = 200_000, least_ranges: int = 128, per_range: int = 64, together: float = 0.02,
) -> DataFrame:
    """Shard and place of each record: ``id_col``, size, text_crc32, shard (0 to ``shards`` - 1), slot (gapless from 0).

    size is the UTF-8 length plus 1 (null text: 1). Shards differ by about one record in bytes. Equal texts stay in
    one shard where their bytes are at most ``together`` of a shard, which may make a shard that much larger or smaller;
    larger groups are cut at the boundary. Ties are ordered by id. The number of ranges follows the row count, so that no task sorts more than a few hundred
    thousand narrow rows. Null ids are ordered first, repeated rows each get a place of their own, and an empty
    input gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
            F.monotonically_increasing_id().alias("_deal"),  # fixed once written: tells rows that repeat id and text apart
        ),
        "sizes",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(least_ranges, math.ceil(n / rows_per_range))
    # a range is full by bytes or by rows: many short copies weigh as much as a few long texts
    keyed = rows.withColumn("_k", F.col("_key").cast("double")).withColumn("_w", F.col("size") / F.lit(float(total or 1)) + F.lit(1.0 / max(n, 1)))
    splits = sampled_splitters(keyed, ranges, per_range, 2.0) or [0.0]
    cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_k", outputCol="_range").transform(keyed)
    full = cut.groupBy("_range").agg(F.sum("_w").alias("_full"))
    parts = F.ceil(F.col("_full") * ranges / 2 / 2).cast("int")  # two even ranges' worth stays whole
    cut = cut.join(F.broadcast(full), "_range").withColumn("_sub", F.pmod(F.xxhash64("_deal", F.lit(11)), F.greatest(parts, F.lit(1))).cast("int"))

    cells = cut.groupBy("_range", "_sub").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_range", "_sub").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        "_range", "_sub",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
    )
    order = W.partitionBy("_range", "_sub").orderBy("_key", F.col("_id").asc_nulls_first(), "size", "text_crc32")
    same = W.partitionBy("_range", "_sub", "_key")
    placed = (
        cut.withColumn("_start", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_row", F.row_number().over(order) - 1)
        .withColumn("_from", F.min("_start").over(same))
        .withColumn("_of", F.sum("size").over(same))
        .join(F.broadcast(cells), ["_range", "_sub"])
    )
    small = F.col("_of") <= F.lit(together * (total or 1) / shards)
    middle = F.col("_bytes0") + F.when(small, F.col("_from") + F.col("_of") / 2).otherwise(F.col("_start") + F.col("size") / 2)
    placed = materialize(
        placed.select(
            "_id", "size", "text_crc32",
            F.least(F.floor(middle * shards / F.lit(total or 1)), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("_rows0") + F.col("_row")).alias("_place"),
        ),
        "placed",
    )
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
