"""Structured Streaming forms of the windowed operators."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.operators.buckets import weighted_avg
from tidemark.scratch import materialize, scratch_dir


def tumbling_sentiment(signals: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Impact-weighted sentiment and volume by asset and window; late rows beyond the watermark are dropped."""
    return (
        signals.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "asset")
        .agg(F.count(F.lit(1)).alias("volume"), weighted_avg("sentiment", "impact").alias("sentiment_weighted"))
        .select("asset", F.col("w.start").alias("start"), "volume", "sentiment_weighted")
    )


def sliding_counts(signals: DataFrame, late: str = "2 hours", width: str = "24 hours", step: str = "1 hour") -> DataFrame:
    return (
        signals.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("impact").alias("impact")).select("category", F.col("w.end").alias("end"), "n", "impact")
    )


def step_counts(signals: DataFrame, late: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Counts and impact of a window's steps: a row enters one step, however wide the windows are that are put together from
    steps afterwards (``joins.sliding_sums``)."""
    return (
        signals.withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"), "category")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("impact").alias("impact")).select("category", F.col("w.start").alias("start"), "rows", "impact")
    )


def dedup_stream(messages: DataFrame, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark; keep a hash of long texts in ``keys`` rather than the texts."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def enrich(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream joined with a small static table; Spark re-reads the static side for every batch."""
    return stream.join(static, key, "left")


def entity_sessions(signals: DataFrame, key: str, gap: str, late: str = "2 hours") -> DataFrame:
    """Runs of a key's rows less than ``gap`` apart. Spark joins sessions that touch, so its own gap ends a microsecond earlier."""
    session = F.session_window("ts", f"{gap} -1 microsecond")
    return signals.withWatermark("ts", late).groupBy(session.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("first"), "n")


def upsert_sink(stream: DataFrame, path: str, key: str, checkpoint: str, buckets: int = 32):
    """Keep the latest row of each key (of equal times, one by hash). Rows lie in buckets by key; a batch rewrites the
    buckets that its keys are in, and a list of each bucket's last version is written with it. Version n is batch n's, so a
    batch that is run again writes the same one. ``read_upserts`` gives the rows."""
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, n: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", F.xxhash64(*batch.columns))).alias("r")).select("r.*")
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = materialize(latest.withColumn("_bucket", bucket), "batch")
        hit = {r[0] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets``
        last = bucket_versions(spark, path, n - 1) if n else {}
        old = [f"{path}/rows/version={v}/_bucket={b}" for b, v in last.items() if b in hit]
        if old:
            kept = spark.read.schema(schema).parquet(*old).join(new.select(key), key, "left_anti").withColumn("_bucket", bucket)
            new = new.unionByName(kept.select(new.columns))
        new.repartition(max(1, len(hit)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows/version={n}")
        rows = sorted({**last, **dict.fromkeys(hit, n)}.items())
        spark.createDataFrame(rows, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/list/version={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def bucket_versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").parquet(f"{path}/list/version={n}").collect()}


def read_upserts(spark: SparkSession, path: str, schema, n: int) -> DataFrame:
    """The table as of batch ``n``."""
    paths = [f"{path}/rows/version={v}/_bucket={b}" for b, v in bucket_versions(spark, path, n).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_in_order(df: DataFrame, base: str, slices: int = 4, order: str = "ts", files: int = 4) -> None:
    """Rows as Parquet files in ``base``/in, in ``slices`` of ``order`` written one after the other: a stream takes them up by age.
    Each slice is written by ``files`` tasks, as one to ``files`` files."""
    at = F.unix_micros(order)
    cuts = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if lo is None else df.where(at >= lo)
        (part if hi is None else part.where(at < hi)).repartition(files).write.mode("append").parquet(f"{base}/in")


def replay(df: DataFrame, transform: Callable[[DataFrame], DataFrame], slices: int = 4, order: str = "ts", mode: str = "append", close: str | None = None, files: int = 4) -> DataFrame:
    """Run ``transform`` as a stream over ``df`` split into slices by ``order``, and give what it wrote. ``close`` is how long
    after the last event marker rows (null but for ``order``) follow: if that is the lateness and a window's width or more,
    the watermark passes every window with events, and the markers' own windows stay open."""
    spark: SparkSession = df.sparkSession
    base = scratch_dir(spark)
    write_in_order(df, base, slices, order, files)
    if close:
        last = df.agg((F.max(order) + F.expr(f"INTERVAL {close}")).alias(order)).where(F.col(order).isNotNull())
        marker = last.select(*[(F.col(order) if f.name == order else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
        # a batch takes ``files`` files; the markers' second batch is the first to see the watermark that the first one moved
        for _ in range(2 * files):
            marker.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = transform(stream)
    query = out.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


class LateGroups(StreamingQueryListener):
    """Adds up, over every progress record of every query that runs while it is attached, the groups that were dropped as
    later than the watermark (after partial aggregation), by query id. ``spark.streams.addListener(LateGroups())``."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, set[int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, own = event.progress, str(event.progress.id)
        if p.batchId not in self.batches.setdefault(own, set()):  # an idle trigger repeats its last record
            self.batches[own].add(p.batchId)
            self.dropped[own] = self.dropped.get(own, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def total(self, query, wait: float = 60.0) -> int:
        """Groups dropped by a finished query; records arrive a little after it ends."""
        until = time.monotonic() + wait
        while str(query.id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        if str(query.id) not in self.ended:
            raise TimeoutError("the query's end was not reported")
        return self.dropped.get(str(query.id), 0)


def late_rows_sink(stream: DataFrame, path: str, checkpoint: str, late: str = "2 hours", order: str = "ts"):
    """Split a stream by its own watermark before any aggregate: rows earlier than the latest time of the batches before less
    ``late`` are told apart from all others, in one folder a batch. A batch that is run again writes the same folder.
    ``read_split`` gives either. Rows without a time are not late."""
    spark = stream.sparkSession

    def split(batch: DataFrame, n: int) -> None:
        before = spark.read.schema("batch bigint, mark timestamp").parquet(f"{path}/marks/batch={n - 1}").first()["mark"] if n else None
        rows = materialize(batch, "batch")
        mark = rows.agg((F.max(order) - F.expr(f"INTERVAL {late}")).alias("mark")).select(F.greatest("mark", F.lit(before).cast("timestamp")).alias("mark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")
        is_late = F.coalesce(F.col(order) < F.lit(before).cast("timestamp"), F.lit(False))
        rows.withColumn("late", is_late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={n}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_split(spark: SparkSession, path: str, schema, late: bool = True) -> DataFrame:
    """The late rows, or the others, of ``late_rows_sink``, with the batch. Only their folders are read."""
    fields = [*schema.fields, StructField("batch", LongType()), StructField("late", BooleanType())]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/rows").where(F.col("late") == late).drop("late")


def dropped_late(query) -> int:
    """Groups that a finished query dropped as later than its watermark, from its own records. A query keeps its last ones
    only: raises if some are gone; attach ``LateGroups`` before a longer query."""
    if query.lastProgress and query.lastProgress["batchId"] + 1 > len({p["batchId"] for p in query.recentProgress}):
        raise ValueError("the query's first progress records are gone; attach LateGroups before it starts")
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p.get("stateOperators", []))
