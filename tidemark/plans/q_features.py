"""Queries of the bucketed aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import buckets as B
from tidemark.operators import series as S
from tidemark.plans.registry import query, r6

_W = "coalesce(sum(sentiment * impact) FILTER (WHERE {0}) / nullif(sum(impact) FILTER (WHERE {0}), 0), 0)"


def _rounded(df, keys, ints=()):
    return df.select(*keys, *ints, *[r6(c).alias(c) for c in df.columns if c not in keys and c not in ints])


@query("SELECT asset, hr, count(*) AS n, round(avg(sentiment), 6) + 0.0 AS mean FROM v_signal GROUP BY 1, 2")
def e1_tumbling_bucket(view, table):
    out = B.bucket(view("v_signal"), "1 hour", ["asset"], [F.count(F.lit(1)).alias("n"), r6(F.avg("sentiment")).alias("mean")])
    hr = F.timestamp_diff("HOUR", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), "bucket")
    return out.select("asset", hr.alias("hr"), "n", "mean")


@query(f"SELECT asset, hr, round({_W.format('true')}, 6) + 0.0 AS sentiment_weighted FROM v_signal GROUP BY 1, 2")
def e2_weighted_sentiment(view, table):
    return view("v_signal").groupBy("asset", "hr").agg(r6(B.weighted_avg("sentiment", "impact")).alias("sentiment_weighted"))


@query("SELECT asset, hr, " + ", ".join(f"round({_W.format(f"category = '{c}'")}, 6) + 0.0 AS sentiment_{c}, count(*) FILTER (WHERE category = '{c}') AS volume_{c}" for c in B.CATEGORIES) + " FROM v_signal GROUP BY 1, 2")
def e3_category_features(view, table):
    out = view("v_signal").groupBy("asset", "hr").agg(*B.category_features(B.CATEGORIES))
    return _rounded(out, ["asset", "hr"], [f"volume_{c}" for c in B.CATEGORIES])


_STRATA = f"""round({_W.format('impact >= 8')}, 6) + 0.0 AS sentiment_high_impact, round({_W.format('impact >= 5')}, 6) + 0.0 AS sentiment_medium_impact,
       count(*) FILTER (WHERE impact >= 8) AS volume_high_impact, count(*) FILTER (WHERE impact >= 5 AND impact < 8) AS volume_medium_impact, count(*) FILTER (WHERE impact < 5) AS volume_low_impact"""
_FACT = f"""round({_W.format('is_fact')}, 6) + 0.0 AS sentiment_fact, round({_W.format('NOT is_fact')}, 6) + 0.0 AS sentiment_opinion,
       count(*) FILTER (WHERE is_fact) AS volume_fact, count(*) FILTER (WHERE NOT is_fact) AS volume_opinion, round(coalesce(count(*) FILTER (WHERE is_fact) / nullif(count(is_fact), 0), 0), 6) + 0.0 AS fact_ratio"""
_ATT = "CAST(sum({0}) AS BIGINT) AS attention, round(coalesce(sum(sentiment * {0}) / nullif(sum({0}), 0), 0), 6) + 0.0 AS sentiment_attention"
_POL = """count(*) FILTER (WHERE sentiment > 0) AS n_positive, count(*) FILTER (WHERE sentiment < 0) AS n_negative, count(*) FILTER (WHERE sentiment = 0) AS n_neutral,
       round(coalesce(stddev_samp(sentiment), 0), 6) + 0.0 AS sentiment_dispersion, round(avg(impact), 6) + 0.0 AS mean_impact, max(impact) AS max_impact"""
_STRATA_INTS = ["volume_high_impact", "volume_medium_impact", "volume_low_impact"]
_FACT_INTS = ["volume_fact", "volume_opinion"]
_POL_INTS = ["n_positive", "n_negative", "n_neutral", "max_impact"]


@query(f"SELECT asset, hr, {_STRATA} FROM v_signal GROUP BY 1, 2")
def e4_impact_strata(view, table):
    return _rounded(view("v_signal").groupBy("asset", "hr").agg(*B.impact_strata()), ["asset", "hr"], _STRATA_INTS)


@query(f"SELECT asset, hr, {_FACT} FROM v_signal GROUP BY 1, 2")
def e5_fact_opinion(view, table):
    return _rounded(view("v_signal").groupBy("asset", "hr").agg(*B.fact_opinion()), ["asset", "hr"], _FACT_INTS)


@query(" UNION ALL ".join(f"SELECT '{v}' AS variant, asset, hr, {_ATT.format(e)} FROM v_signal GROUP BY 2, 3" for v, e in (("product", "(views * forwards)"), ("reach", "(greatest(views, 1) * (1 + forwards))"), ("daily", "(views + 10 * forwards)"))))
def e6_attention(view, table):
    parts = []
    for variant in ("product", "reach", "daily"):
        out = view("v_signal").groupBy("asset", "hr").agg(*B.attention_features(variant)).withColumn("variant", F.lit(variant))
        parts.append(_rounded(out, ["variant", "asset", "hr"], ["attention"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT asset, hr, {_POL} FROM v_signal GROUP BY 1, 2")
def e7_polarity(view, table):
    return _rounded(view("v_signal").groupBy("asset", "hr").agg(*B.polarity_features()), ["asset", "hr"], _POL_INTS)


@query(f"""
WITH f AS (
  SELECT asset, hr, count(*) AS volume, {_W.format('true')} AS sw, {_STRATA}, {_FACT}, {_ATT.format('(views * forwards)')}, {_POL}
  FROM v_signal GROUP BY 1, 2)
SELECT asset, hr, volume, round(sw, 6) + 0.0 AS sentiment_weighted, sentiment_high_impact, volume_high_impact, sentiment_fact, fact_ratio, attention, n_positive, n_negative, sentiment_dispersion,
       round(avg(sw) OVER w24, 6) + 0.0 AS ma24, round(sw - avg(sw) OVER w24, 6) + 0.0 AS momentum
FROM f WINDOW w24 AS (PARTITION BY asset ORDER BY hr ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def e8_hourly_features(view, table):
    """Flagship: hourly feature row of each asset with 24-row moving average and momentum."""
    f = B.hourly_features(view("v_signal"))
    f = f.withColumn("ma24", S.rolling_mean("sentiment_weighted", 24, ["asset"], "hr")).withColumn("momentum", F.col("sentiment_weighted") - F.col("ma24"))
    ints = ["volume", "volume_high_impact", "attention", "n_positive", "n_negative"]
    return f.select("asset", "hr", *ints, *[r6(c).alias(c) for c in ("sentiment_weighted", "sentiment_high_impact", "sentiment_fact", "fact_ratio", "sentiment_dispersion", "ma24", "momentum")])


@query("""SELECT 'channel' AS "column", channel AS value, count(*) AS n FROM v_signal GROUP BY channel UNION ALL SELECT 'category', category, count(*) FROM v_signal GROUP BY category
UNION ALL SELECT 'sentiment', CAST(sentiment AS STRING), count(*) FROM v_signal GROUP BY sentiment UNION ALL SELECT 'day', CAST(day AS STRING), count(*) FROM v_signal GROUP BY day""")
def e9_value_counts(view, table):
    return B.value_counts(view("v_signal"), ["channel", "category", "sentiment", "day"])


@query("""SELECT entity, count(*) AS mentions, round(avg(impact), 6) AS avg_impact, round(avg(sentiment), 6) + 0.0 AS avg_sentiment, min(type) AS type,
string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM v_mention GROUP BY 1""")
def e10_entity_stats(view, table):
    return B.entity_stats(view("v_mention")).withColumns({c: r6(c) for c in ("avg_impact", "avg_sentiment")})


@query("""WITH c AS (SELECT entity, 'T' || (l_partkey % 7) AS ticker, count(*) AS n FROM v_mention WHERE l_partkey % 7 > 1 GROUP BY 1, 2), t AS (SELECT entity, ticker FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, ticker) = 1)
SELECT v.entity, count(*) AS mentions, any_value(t.ticker) AS ticker FROM v_mention v LEFT JOIN t ON v.entity = t.entity GROUP BY 1""")
def e10_entity_tickers(view, table):
    """Most frequent ticker of each entity; some mentions have none."""
    ticker = F.when(F.col("l_partkey") % 7 > 1, F.concat(F.lit("T"), F.col("l_partkey") % 7)).when(F.col("l_partkey") % 7 == 1, "")
    return B.entity_stats(view("v_mention").withColumn("ticker", ticker)).select("entity", "mentions", "ticker")


@query("""WITH m AS (SELECT day, count(*) FILTER (WHERE type = 'F') AS n_type_F, count(*) FILTER (WHERE type = 'O') AS n_type_O FROM v_mention GROUP BY 1),
e AS (SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, count(*) AS events, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS views_sum, round(avg(CAST(floor(o_totalprice) AS BIGINT)), 4) AS views_mean FROM orders GROUP BY 1)
SELECT m.*, events, views_sum, views_mean FROM m JOIN e ON m.day = e.day""")
def e12_views_and_types(view, table):
    """Counts by type of entity, and views of the day's events."""
    day = F.expr("CAST(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 86400) AS BIGINT)").alias("day")
    events = table("orders").select(F.col("o_orderkey").alias("event_id"), day, F.floor("o_totalprice").cast("bigint").alias("views"))
    out = B.daily_discourse(view("v_mention"), events, [], ["F", "O"])
    return out.select("day", "n_type_F", "n_type_O", "events", "views_sum", r6("views_mean", 4).alias("views_mean"))


@query("SELECT CAST(floor(day / 30) AS BIGINT) AS month, count(DISTINCT entity) AS entity, count(DISTINCT category) AS category FROM v_mention GROUP BY 1")
def e12_distinct_roll_up(view, table):
    """Distinct entities of 30-day windows from daily sketches; few values are counted exactly."""
    daily = B.distinct_sketches(view("v_mention"), ["day"], ["entity", "category"])
    return B.roll_up_distinct(daily, F.floor(F.col("day") / 30), name="month")


@query("""WITH a AS (SELECT role AS model, length(text) > 40 AS ok, length(text) % 3 > 0 AS typed FROM conversations)
SELECT model, count(*) AS n, round(count(*) FILTER (WHERE ok AND typed) / count(*) FILTER (WHERE ok), 6) AS type_rate FROM a GROUP BY 1""")
def e13_type_rate(view, table):
    """Share of valid annotations that name a type."""
    n = F.length("text")
    long = table("conversations").select(F.col("role").alias("model"), (n > 40).alias("ok"), F.lit(1.0).alias("impact"), F.lit(1).alias("entities"), F.lit(0).alias("sentiment"), F.lit(False).alias("conflict"), F.when(n % 3 == 1, "TOKEN").when(n % 3 == 2, "TOKEN|CEX").otherwise("").alias("types"))
    return B.annotator_summary(long).select("model", "n", r6("type_rate").alias("type_rate"))


@query("SELECT channel, count(*) AS messages, round(avg(views), 6) AS avg_views FROM v_message GROUP BY 1")
def e11_channel_stats(view, table):
    return B.channel_stats(view("v_message")).withColumn("avg_views", r6("avg_views"))


@query("""WITH m AS (SELECT day, count(DISTINCT entity) AS entities, count(*) AS mentions, round(avg(sentiment), 6) + 0.0 AS sentiment_mean, round(coalesce(stddev_samp(sentiment), 0), 6) AS sentiment_std,
 round(count(*) FILTER (WHERE sentiment > 0) / count(*), 6) AS positive_ratio, round(count(*) FILTER (WHERE sentiment < 0) / count(*), 6) AS negative_ratio, round(avg(impact), 6) AS impact_mean,
 CAST(sum(impact) AS BIGINT) AS impact_sum, round(count(*) FILTER (WHERE impact >= 8) / count(*), 6) AS high_impact_ratio, count(*) FILTER (WHERE category = 'A') AS n_A, count(*) FILTER (WHERE category = 'N') AS n_N,
 count(*) FILTER (WHERE category = 'R') AS n_R FROM v_mention GROUP BY 1),
e AS (SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, count(*) AS events FROM orders GROUP BY 1)
SELECT m.*, events FROM m JOIN e ON m.day = e.day""")
def e12_daily_discourse(view, table):
    events = table("orders").select(F.col("o_orderkey").alias("event_id"), F.expr("CAST(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) / 86400) AS BIGINT)").alias("day"))
    out = B.daily_discourse(view("v_mention"), events, ["A", "N", "R"])
    return _rounded(out, ["day"], ["entities", "mentions", "impact_sum", "n_A", "n_N", "n_R", "events"])


@query("""WITH a AS (SELECT role AS model, length(text) > 40 AS ok, CAST(length(text) % 10 + 1 AS DOUBLE) AS impact, length(text) % 4 AS entities, length(text) % 3 - 1 AS sentiment, length(text) % 5 = 0 AS conflict FROM conversations)
SELECT model, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS success_rate, round(avg(impact), 6) AS impact_mean, round(stddev_samp(impact), 6) AS impact_std, round(avg(CAST(entities > 0 AS INT)), 6) AS entity_rate,
count(*) FILTER (WHERE sentiment > 0) AS positive, count(*) FILTER (WHERE sentiment < 0) AS negative, round(avg(CAST(conflict AS INT)), 6) AS conflict_rate FROM a GROUP BY 1""")
def e13_annotator_summary(view, table):
    n = F.length("text")
    long = table("conversations").select(F.col("role").alias("model"), (n > 40).alias("ok"), (n % 10 + 1).cast("double").alias("impact"), (n % 4).alias("entities"), (n % 3 - 1).alias("sentiment"), (n % 5 == 0).alias("conflict"))
    return _rounded(B.annotator_summary(long), ["model"], ["n", "positive", "negative"])


@query("""SELECT count(*) AS requests, CAST(sum(k + 100) AS BIGINT) AS tokens_in, CAST(sum(k) AS BIGINT) AS tokens_out, round(sum(k + 100) * 0.0375 / 1e6 + sum(k) * 0.15 / 1e6, 6) AS cost FROM v_signal""")
def e14_usage_cost(view, table):
    usage = view("v_signal").select((F.col("k") + 100).alias("prompt_tokens"), F.col("k").alias("completion_tokens"))
    return B.usage_cost(usage, 0.0375, 0.15).withColumn("cost", r6("cost"))


@query("""WITH j AS (SELECT day, count(*) AS total, count(*) FILTER (WHERE k < 80) AS completed, count(*) FILTER (WHERE k >= 95) AS failed, min(sec) AS created FROM v_signal GROUP BY 1),
t AS (SELECT count(*) AS jobs, CAST(sum(total) AS BIGINT) AS total, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, min(created) AS began FROM j)
SELECT jobs, total, completed, failed, round(100.0 * completed / total, 6) AS percent, round(completed / (1709251200 - began), 6) AS rate, round((total - completed - failed) / (completed / (1709251200 - began)), 3) AS eta FROM t""")
def e15_batch_progress(view, table):
    jobs = view("v_signal").groupBy("day").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("k") < 80).alias("completed"), F.count_if(F.col("k") >= 95).alias("failed"), F.min("sec").alias("created"))
    out = B.batch_progress(jobs, F.lit(1709251200))
    return out.withColumns({"percent": r6("percent"), "rate": r6("rate"), "eta": r6("eta", 3)})


@query("""WITH q AS (SELECT asset, unnest([0.25, 0.5, 0.75]) AS p FROM (SELECT DISTINCT asset FROM v_signal))
SELECT q.asset, CAST(p AS DOUBLE) AS p, round(CASE WHEN p = 0.25 THEN a ELSE CASE WHEN p = 0.5 THEN b ELSE c END END, 6) AS value FROM q JOIN
(SELECT asset, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM v_signal GROUP BY 1) s ON q.asset = s.asset""")
def e16_quantiles(view, table):
    return B.quantiles(view("v_signal"), "value", [0.25, 0.5, 0.75], ["asset"]).withColumn("value", r6("value"))


@query("""WITH h AS (SELECT DISTINCT asset, hr FROM v_signal), g AS (SELECT asset, hr, hr - lag(hr) OVER (PARTITION BY asset ORDER BY hr) AS gap FROM h)
SELECT asset, count(*) AS present, max(hr) - min(hr) + 1 AS span, round(count(*) / (max(hr) - min(hr) + 1), 6) AS coverage, max(gap) AS max_gap, count(*) FILTER (WHERE gap <> 1) AS n_gaps FROM g GROUP BY 1""")
def e18_coverage(view, table):
    hours = view("v_signal").select("asset", "hr").distinct()
    return S.coverage_report(hours, ["asset"], "hr").withColumn("coverage", r6("coverage"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) + 0.0 AS mean, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM v_signal" for c in ("value", "sentiment", "impact")))
def e19_summary_stats(view, table):
    return B.summary_stats(view("v_signal"), ["value", "sentiment", "impact"]).withColumns({c: r6(c) for c in ("mean", "median", "std")})
