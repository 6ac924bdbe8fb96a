"""Bucketed aggregates of annotated messages: impact-weighted sentiment, strata, attention, polarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("signup", "error", "click", "view", "purchase")


def bucket(df: DataFrame, width: str, keys: Sequence[str], aggs: Sequence[Column], ts: str = "ts", name: str = "bucket") -> DataFrame:
    """Tumbling window aggregate in one shuffle; empty buckets have no row."""
    return df.groupBy(*keys, F.window(ts, width)["start"].alias(name)).agg(*aggs)


def weighted_avg(value: Column | str, weight: Column | str) -> Column:
    """Sum of value times weight over sum of weight; 0 where the weights add up to nothing."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.coalesce(F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))


def _where(cond: Column) -> Column:
    """Weighted sentiment of the rows that satisfy ``cond``; null counts as not."""
    return weighted_avg(F.when(cond, F.col("sentiment")), F.when(cond, F.col("impact")))


def category_features(categories: Sequence[str]) -> list[Column]:
    of = lambda c: F.col("category") == c
    return [x for c in categories for x in (_where(of(c)).alias(f"sentiment_{c}"), F.count_if(of(c)).alias(f"volume_{c}"))]


def impact_strata() -> list[Column]:
    """Sentiment of high impact (8 and more) and of medium or more (5); volumes of high, [5, 8) and low impact."""
    i = F.col("impact")
    return [
        _where(i >= 8).alias("sentiment_high_impact"), _where(i >= 5).alias("sentiment_medium_impact"),
        F.count_if(i >= 8).alias("volume_high_impact"), F.count_if((i >= 5) & (i < 8)).alias("volume_medium_impact"), F.count_if(i < 5).alias("volume_low_impact"),
    ]


def fact_opinion() -> list[Column]:
    """Facts and opinions apart; a message of unknown kind is neither. fact_ratio is over the known ones, else 0."""
    fact, opinion = F.col("is_fact"), ~F.col("is_fact")
    return [
        _where(fact).alias("sentiment_fact"), _where(opinion).alias("sentiment_opinion"),
        F.count_if(fact).alias("volume_fact"), F.count_if(opinion).alias("volume_opinion"),
        F.coalesce(F.count_if(fact) / F.nullif(F.count("is_fact"), F.lit(0)), F.lit(0.0)).alias("fact_ratio"),
    ]


def attention_features(variant: str = "product") -> list[Column]:
    """Attention is views * forwards (product), views * (1 + forwards) (reach) or views + 10 * forwards (daily)."""
    views, forwards = F.coalesce("views", F.lit(0)), F.coalesce("forwards", F.lit(0))
    a = {"product": views * forwards, "reach": F.greatest(views, F.lit(1)) * (1 + forwards), "daily": views + 10 * forwards}[variant]
    return [F.sum(a).alias("attention"), weighted_avg(F.col("sentiment"), a.cast("double")).alias("sentiment_attention")]


def polarity_features() -> list[Column]:
    s = F.col("sentiment")
    return [
        F.count_if(s > 0).alias("n_positive"), F.count_if(s < 0).alias("n_negative"), F.count_if(s == 0).alias("n_neutral"),
        F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("sentiment_dispersion"), F.avg("impact").alias("mean_impact"), F.max("impact").alias("max_impact"),
    ]


def hourly_features(df: DataFrame, keys: Sequence[str] = ("asset", "hr"), categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """The whole feature row of an asset and hour: all families above in one aggregate, so one shuffle."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("volume"), weighted_avg("sentiment", "impact").alias("sentiment_weighted"), F.avg("sentiment").alias("sentiment_mean"),
        *category_features(categories), *impact_strata(), *fact_opinion(), *attention_features(), *polarity_features(),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts by each of several columns at once: column, value, n (grouping sets, one pass)."""
    sets = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).groupingSets([[c] for c in columns], *columns)
    at = F.element_at(F.array(*[F.lit(c) for c in columns]), F.lit(len(columns)) - F.log2((2 ** len(columns) - 1 - F.col("_g")).cast("double")).cast("int"))
    counted = sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    value = F.coalesce(*columns)
    return counted.select(at.alias("column"), value.alias("value"), "n")


def entity_stats(mentions: DataFrame) -> DataFrame:
    """Mentions, means, least type, ticker (the most frequent, of ties the least; only if there is such a column), categories."""
    stats = mentions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("mentions"), F.avg("impact").alias("avg_impact"), F.avg("sentiment").alias("avg_sentiment"),
        F.min("type").alias("type"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    if "ticker" not in mentions.columns:
        return stats
    counts = mentions.where("ticker IS NOT NULL AND ticker <> ''").groupBy("entity", "ticker").agg(F.count(F.lit(1)).alias("_k"))
    first = counts.groupBy("entity").agg(F.min_by("ticker", F.struct((-F.col("_k")).alias("k"), "ticker")).alias("ticker"))
    return stats.join(first, "entity", "left")


def channel_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.avg("views").alias("avg_views"))


def daily_discourse(mentions: DataFrame, events: DataFrame, categories: Sequence[str], types: Sequence[str] = ()) -> DataFrame:
    """Daily features at two grains: of mentions and of events, joined by day. Counts by type are given for ``types``, sum and mean
    of views if events have them (each event counted once)."""
    s, i = F.col("sentiment"), F.col("impact")
    m = mentions.groupBy("day").agg(
        F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("mentions"), F.avg(s).alias("sentiment_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sentiment_std"),
        (F.count_if(s > 0) / F.count(F.lit(1))).alias("positive_ratio"), (F.count_if(s < 0) / F.count(F.lit(1))).alias("negative_ratio"),
        F.avg(i).alias("impact_mean"), F.sum(i).alias("impact_sum"), (F.count_if(i >= 8) / F.count(F.lit(1))).alias("high_impact_ratio"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories], *[F.count_if(F.col("type") == c).alias(f"n_type_{c}") for c in types],
    )
    if "views" not in events.columns:
        return m.join(events.groupBy("day").agg(F.count_distinct("event_id").alias("events")), "day")
    one = events.groupBy("day", "event_id").agg(F.max("views").alias("_v"))
    e = one.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("_v"), F.lit(0)).alias("views_sum"), F.avg("_v").alias("views_mean"))
    return m.join(e, "day")


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lg_k: int = 12) -> DataFrame:
    """(keys, sketch_<column>): HyperLogLog sketches that can be put together; exact for few values, then off by about
    1 / 2^(lg_k / 2) (1.6 % at 12), whatever the number of rows. A cell is lg_k-sized however many values it has seen."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"sketch_{c}") for c in columns])


def roll_up_distinct(sketches: DataFrame, window: Column, keys: Sequence[str] = (), name: str = "window") -> DataFrame:
    """(keys, window, <column>): estimated distinct values of each window from the sketches of its cells, without the rows."""
    columns = [c for c in sketches.columns if c.startswith("sketch_")]
    found = sketches.withColumn(name, window).groupBy(*keys, name)
    return found.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True))).alias(c.removeprefix("sketch_")) for c in columns])


def annotator_summary(long: DataFrame) -> DataFrame:
    """By model: success rate, impact mean and spread, entity and conflict rate, polarity counts; where there is a column of the
    types found, the share of successful rows that have any."""
    typed = F.col("ok") & (F.coalesce(F.trim("types"), F.lit("")) != "") if "types" in long.columns else None
    rate = [] if typed is None else [F.coalesce(F.count_if(typed) / F.nullif(F.count_if("ok"), F.lit(0)), F.lit(0.0)).alias("type_rate")]
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("impact").alias("impact_mean"), F.stddev_samp("impact").alias("impact_std"),
        F.avg((F.col("entities") > 0).cast("double")).alias("entity_rate"), F.count_if(F.col("sentiment") > 0).alias("positive"), F.count_if(F.col("sentiment") < 0).alias("negative"),
        F.avg(F.col("conflict").cast("double")).alias("conflict_rate"), *rate,
    )


def usage_cost(df: DataFrame, per_million_in: float, per_million_out: float) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"))
    return total.withColumn("cost", F.col("tokens_in") * per_million_in / 1e6 + F.col("tokens_out") * per_million_out / 1e6)


def batch_progress(jobs: DataFrame, now: Column) -> DataFrame:
    """Totals of a job ledger: done and failed requests, percent, requests a second and seconds left."""
    total = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("total").alias("total"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.min("created").alias("began"))
    rate = F.col("completed") / F.nullif(now - F.col("began"), F.lit(0))
    return total.select(
        "jobs", "total", "completed", "failed", (100.0 * F.col("completed") / F.col("total")).alias("percent"), rate.alias("rate"),
        ((F.col("total") - F.col("completed") - F.col("failed")) / F.nullif(rate, F.lit(0.0))).alias("eta"),
    )


def quantiles(df: DataFrame, column: str, ps: Sequence[float], keys: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles, or approximate ones where ``accuracy`` is given: keys, p, value."""
    ps = list(ps)
    q = F.percentile(column, ps) if accuracy is None else F.percentile_approx(column, ps, accuracy)
    found = df.groupBy(*keys).agg(F.arrays_zip(F.lit(ps).cast("array<double>").alias("p"), q.alias("value")).alias("z"))
    return found.select(*keys, F.inline("z").alias("p", "value"))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, median, sample std, min and max of columns, one row each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most")
    )
