"""Queries of time-series operators and of alignment joins, over bars by symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as D
from tidemark.operators import ranges as R
from tidemark.operators import series as S
from tidemark.plans.registry import query, r6

K, T = ["symbol"], "day"
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"


def _in_pieces(df, time, before, after, columns):
    """symbol, time and ``columns(keys)``, whose windows reach so many rows back and ahead; long series are cut."""
    return R.bounded(df, K, time, before, after, lambda d, keys: d.select(*keys, time, "_halo", *columns(keys)))


@query(f"SELECT symbol, day, round(close - lag(close, 1) OVER w, 4) + 0.0 AS d1, round(close - lag(close, 3) OVER w, 4) + 0.0 AS d3, round(close - 2 * lag(close, 1) OVER w + lag(close, 2) OVER w, 4) + 0.0 AS dd FROM v_bars {_W}")
def f1_diff(view, table):
    cols = lambda by: [r6(S.diff("close", 1, by, T), 4).alias("d1"), r6(S.diff("close", 3, by, T), 4).alias("d3"), r6(S.second_diff("close", by, T), 4).alias("dd")]
    return _in_pieces(view("v_bars"), T, 3, 0, cols)


def _mean(w):
    return f"avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query(f"SELECT symbol, day, {', '.join(f'round({_mean(w)}, 4) AS ma{w}' for w in (6, 24, 168))}, round(close - {_mean(24)}, 4) + 0.0 AS momentum FROM v_bars")
def f2_f3_moving_average(view, table):
    means = lambda d, keys: d.select(*K, T, "_halo", *keys[1:], *[r6(S.rolling_mean("close", w, keys, T), 4).alias(f"ma{w}") for w in (6, 24, 168)], r6(S.momentum("close", 24, keys, T), 4).alias("momentum"))
    return R.bounded(view("v_bars"), K, T, 167, 0, means)


@query(f"SELECT symbol, day, {', '.join(f'round(close / lag(close, {k}) OVER w - 1, 6) + 0.0 AS r{k}' for k in (1, 3, 6, 12, 24))}, round(ln(close / lag(close) OVER w), 6) + 0.0 AS lr, round((high - low) / close, 6) AS range_vol FROM v_bars {_W}")
def f4_f5_f6_returns(view, table):
    cols = lambda by: [*[r6(S.returns("close", k, by, T)).alias(f"r{k}") for k in (1, 3, 6, 12, 24)], r6(S.log_return("close", by, T)).alias("lr"), r6(S.range_vol()).alias("range_vol")]
    return _in_pieces(view("v_bars"), T, 24, 0, cols)


_LR = "WITH r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM v_bars)"


def _with_r(view):
    return view("v_bars").withColumn("r", S.log_return("close", K, T))


@query(f"""{_LR} SELECT symbol, day, CASE WHEN count(r) OVER b = 20 THEN round(stddev_samp(r) OVER b * sqrt(365), 6) END AS vol20,
CASE WHEN count(r) OVER f = 24 THEN round(stddev_samp(r) OVER f, 6) END AS fwd24 FROM r
WINDOW b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)""")
def f7_f11_rolling_vol(view, table):
    def vols(d, keys):
        d = d.withColumn("r", S.log_return("close", keys, T))
        return d.select(*K, T, "_halo", *keys[1:], r6(S.rolling_vol("r", 20, keys, T, 365)).alias("vol20"), r6(S.forward_realized_vol("r", 24, keys, T)).alias("fwd24"))

    return R.bounded(view("v_bars"), K, T, 20, 24, vols)


@query(f"""{_LR} SELECT symbol, day, {', '.join(f'round(lead(close, {h}) OVER w - close, 4) + 0.0 AS c{h}' for h in (1, 3, 6, 12, 24))},
CASE WHEN lead(day, 5) OVER w = day + 5 THEN round(lead(close, 5) OVER w, 4) END AS level5, round(abs(lead(r) OVER w), 6) AS abs_next, sign(lead(r) OVER w) + 0.0 AS sign_next FROM r {_W}""")
def f8_f9_f10_forward_targets(view, table):
    def targets(d, keys):
        d = d.withColumn("r", S.log_return("close", keys, T))
        cols = [r6(S.forward_change("close", h, keys, T), 4).alias(f"c{h}") for h in (1, 3, 6, 12, 24)]
        nxt = S.forward_value("r", 1, keys, T)
        return d.select(*keys, T, "_halo", *cols, r6(S.forward_value("close", 5, keys, T, 1), 4).alias("level5"), r6(F.abs(nxt)).alias("abs_next"), (F.signum(nxt) + F.lit(0.0)).alias("sign_next"))

    return R.bounded(view("v_bars"), K, T, 1, 24, targets)


@query("SELECT a.symbol, a.day, CAST(l.lag AS INT) AS lag, round(b.close, 4) AS value FROM v_bars a CROSS JOIN (SELECT unnest([1, 2, 3, 6, 12, 24, 48, 72]) AS lag) l JOIN v_bars b ON b.symbol = a.symbol AND b.day = a.day - l.lag")
def f12_lag_matrix(view, table):
    return S.lag_matrix(view("v_bars"), "close", [1, 2, 3, 6, 12, 24, 48, 72], K, T).withColumn("value", r6("value", 4))


@query("""WITH s AS (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s FROM v_bars GROUP BY 1)
SELECT b.symbol, day, volume > m + 2 * s AS spike_2, volume > m + 1.5 * s AS spike_1_5,
coalesce(volume > avg(volume) OVER p + 2 * stddev_samp(volume) OVER p, false) AS causal FROM v_bars b JOIN s ON b.symbol = s.symbol WINDOW p AS (PARTITION BY b.symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def f13_spike_flags(view, table):
    df = S.causal_spikes(view("v_bars"), "volume", 2.0, K, T)
    return S.spike_flags(df, "volume", [2, 1.5], K).select("symbol", "day", "spike_2", "spike_1_5", "causal")


@query("""WITH s AS (SELECT symbol, avg(volume) mv, stddev_pop(volume) sv, avg(close) mc, stddev_pop(close) sc FROM v_bars GROUP BY 1)
SELECT b.symbol, day, abs(volume - mv) / sv > 2 OR abs(close - mc) / sc > 2 AS outlier FROM v_bars b JOIN s ON b.symbol = s.symbol""")
def f14_zscore_mask(view, table):
    return S.zscore_mask(view("v_bars"), ["volume", "close"], 2.0, K).select("symbol", "day", "outlier")


@query("""WITH r AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY close, day) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM v_bars),
e AS (SELECT symbol, min(close) FILTER (WHERE r > floor(n * 0.01)) AS lo, max(close) FILTER (WHERE r <= n - floor(n * 0.01)) AS hi FROM r GROUP BY 1)
SELECT v_bars.symbol, day, round(least(greatest(close, lo), hi), 4) AS close FROM v_bars JOIN e ON v_bars.symbol = e.symbol""")
def f15_winsorize(view, table):
    return S.winsorize(view("v_bars"), "close", 0.01, K).select("symbol", "day", r6("close", 4).alias("close"))


@query("""WITH m AS (SELECT symbol, quantile_cont(close, 0.5) AS c, quantile_cont(volume, 0.5) AS v FROM v_bars GROUP BY 1)
SELECT b.symbol, day, close > avg(close) OVER (PARTITION BY b.symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS bull, close > c AS above_median, volume > v AS high_vol FROM v_bars b JOIN m ON b.symbol = m.symbol""")
def f16_regime_flags(view, table):
    return S.regime_flags(view("v_bars"), "close", "volume", 7, K, T).select("symbol", "day", "bull", "above_median", "high_vol")


@query("SELECT symbol, day, CASE WHEN count(*) OVER w = 168 THEN round(corr(close, volume) OVER w, 6) + 0.0 END AS r FROM v_bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)")
def f17_rolling_corr(view, table):
    return R.bounded(view("v_bars"), K, T, 167, 0, lambda d, keys: d.select(*K, T, "_halo", *keys[1:], r6(S.rolling_corr("close", "volume", 168, keys, T)).alias("r")))


@query(f"""{_LR}, p AS (SELECT a.day, a.symbol AS a, b.symbol AS b, a.r AS x, b.r AS y FROM r a JOIN r b ON a.day = b.day AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
c AS (SELECT day, CASE WHEN count(*) OVER w = 20 THEN corr(x, y) OVER w END AS r FROM p WINDOW w AS (PARTITION BY a, b ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT day, round(avg(r), 6) + 0.0 AS avg_corr FROM c GROUP BY 1""")
def f18_rolling_pair_corr(view, table):
    return S.rolling_avg_pair_corr(_with_r(view), "r", 20, "symbol", "day").withColumn("avg_corr", r6("avg_corr"))


@query('SELECT symbol, day, round(100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY day), 4) AS "index", round(close / sum(close) OVER (PARTITION BY day), 6) AS share FROM v_bars')
def f19_rebased_share(view, table):
    return S.rebased_share(view("v_bars"), "close", "symbol", "day").select("symbol", "day", r6("index", 4).alias("index"), r6("share").alias("share"))


@query(" UNION ALL ".join(f"SELECT symbol, {k} AS lag, round(corr(volume, l), 6) + 0.0 AS r FROM (SELECT symbol, volume, lag(volume, {k}) OVER (PARTITION BY symbol ORDER BY day) AS l FROM v_bars) GROUP BY 1" for k in (1, 2, 3, 6, 12, 24)))
def f20_autocorr(view, table):
    return S.autocorr(view("v_bars"), "volume", [1, 2, 3, 6, 12, 24], K, T).withColumn("r", r6("r"))


@query(f"SELECT symbol, day, round(coalesce(CASE WHEN day - lag(day) OVER w = 1 THEN lag(close) OVER w END, 0), 4) AS baseline FROM v_bars {_W}")
def f21_persistence(view, table):
    return _in_pieces(view("v_bars"), T, 1, 0, lambda by: [r6(S.persistence("close", by, T, 1), 4).alias("baseline")])


@query("""SELECT symbol, day, 24 AS length, round(s, 4) AS total FROM (SELECT symbol, day, count(*) OVER w AS n, min(day) OVER w AS d, sum(close) OVER w AS s FROM v_bars
WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE n = 24 AND day - d = 23""")
def f22_sequence_windows(view, table):
    seq = R.bounded(view("v_bars"), K, T, 23, 0, lambda d, keys: S.sequence_windows(d, ["close"], 24, keys, T, 1))
    return seq.select("symbol", "day", F.size("window").alias("length"), r6(F.aggregate("window", F.lit(0.0), lambda a, x: a + x["close"]), 4).alias("total"))


@query("""WITH n AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM v_bars)
SELECT symbol, CAST(least(floor((r - 1) / floor(n / 5)), 4) AS INT) AS slice, count(*) AS n, round(avg(close), 4) AS mean FROM n GROUP BY 1, 2""")
def f23_consecutive_slices(view, table):
    return S.consecutive_slices(view("v_bars"), 5, K, T).groupBy("symbol", "slice").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("close"), 4).alias("mean"))


@query("SELECT day, round(avg((high - low) / close), 6) AS mean FROM v_bars GROUP BY 1")
def f24_cross_section_mean(view, table):
    return S.cross_section_mean(view("v_bars").withColumn("rv", S.range_vol()), "rv", "day").withColumn("mean", r6("mean"))


@query("""WITH g AS (SELECT symbol, unnest(range(min(hr), max(hr) + 1)) AS hr FROM v_bars_hourly GROUP BY symbol)
SELECT g.symbol, g.hr, b.hr IS NOT NULL AS observed, round(close, 4) AS close FROM g LEFT JOIN v_bars_hourly b ON g.symbol = b.symbol AND g.hr = b.hr""")
def m3_complete_grid(view, table):
    return S.complete_grid(view("v_bars_hourly"), K, "hr").select("symbol", "hr", "observed", r6("close", 4).alias("close"))


@query("""WITH t AS (SELECT DISTINCT asset, channel, sec FROM v_signal), b AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 21600 THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY asset, channel ORDER BY sec)),
r AS (SELECT *, sum(b) OVER (PARTITION BY asset, channel ORDER BY sec ROWS UNBOUNDED PRECEDING) AS run FROM b), i AS (SELECT asset, min(sec) AS first, max(sec) AS last FROM r GROUP BY asset, channel, run),
g AS (SELECT symbol, unnest(range(min(hr), max(hr) + 1)) AS hr FROM v_bars_hourly GROUP BY symbol)
SELECT g.symbol, g.hr, CASE WHEN b.hr IS NOT NULL THEN 'observed' WHEN EXISTS (SELECT 1 FROM i WHERE i.asset = g.symbol AND floor(first / 3600) <= g.hr AND floor(last / 3600) >= g.hr) THEN 'empty' ELSE 'uncovered' END AS state
FROM g LEFT JOIN v_bars_hourly b ON g.symbol = b.symbol AND g.hr = b.hr""")
def m3_hour_states(view, table):
    """Every hour of each asset: observed, empty while one of its channels was being collected, or not covered at all."""
    collected = view("v_signal").select(F.col("asset").alias("symbol"), "channel", "sec")
    grid = S.complete_grid(view("v_bars_hourly").select("symbol", "hr"), K, "hr")
    return S.hour_states(grid, S.coverage_intervals(collected, ["symbol", "channel"], "sec", 21600), K, "hr").select("symbol", "hr", "state")


_HR = "WITH r AS (SELECT *, CASE WHEN hr - lag(hr) OVER w = 1 THEN ln(close / lag(close) OVER w) END AS r FROM v_bars_hourly WINDOW w AS (PARTITION BY symbol ORDER BY hr))"


@query(f"""{_HR} SELECT symbol, hr, CASE WHEN count(r) OVER f = 24 THEN round(sum(r * r) OVER f, 6) END AS rv24, {', '.join(f'round(sqrt(avg(r * r) OVER (PARTITION BY symbol ORDER BY hr RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)), 6) AS risk{h}' for h in (24, 168, 720))}
FROM r WINDOW f AS (PARTITION BY symbol ORDER BY hr RANGE BETWEEN 1 FOLLOWING AND 24 FOLLOWING)""")
def m4_m5_risk(view, table):
    def risks(d, keys):
        d = d.withColumn("r", S.log_return("close", keys, "hr", 1))
        return d.select(*keys, "hr", "_halo", r6(S.future_realized_variance("r", 24, keys, "hr")).alias("rv24"), *[r6(S.past_risk("r", h, keys, "hr")).alias(f"risk{h}") for h in (24, 168, 720)])

    return R.bounded(view("v_bars_hourly"), K, "hr", 720, 24, risks)  # hours are unique, so a range of hours has no more rows


@query("""WITH f AS (SELECT asset AS symbol, hr, count(*) AS n FROM v_signal GROUP BY 1, 2) SELECT f.symbol, f.hr, n, round(close, 4) AS close FROM f JOIN v_bars_hourly b ON f.symbol = b.symbol AND f.hr = b.hr""")
def d1_join_market(view, table):
    f = view("v_signal").groupBy(F.col("asset").alias("symbol"), "hr").agg(F.count(F.lit(1)).alias("n"))
    return D.join_market(f, view("v_bars_hourly"), ["symbol", "hr"]).select("symbol", "hr", "n", r6("close", 4).alias("close"))


@query("SELECT m.msg_id, m.channel, quality FROM v_message m LEFT JOIN labels ON m.msg_id = doc_id")
def d2_attach_annotations(view, table):
    labels = table("labels").select(F.col("doc_id").alias("msg_id"), "quality")
    return D.attach_annotations(view("v_message").select("msg_id", "channel"), labels, "msg_id")


@query("SELECT day, round(max(close) FILTER (WHERE symbol = 'A'), 4) AS A, round(max(close) FILTER (WHERE symbol = 'N'), 4) AS N, round(max(close) FILTER (WHERE symbol = 'R'), 4) AS R FROM v_bars GROUP BY 1")
def d3_join_outer_all(view, table):
    bars = view("v_bars").withColumn("close", r6("close", 4))
    return D.join_outer_all({s: bars.where(F.col("symbol") == s) for s in "ANR"}, "day", "close")


@query("""WITH s AS (SELECT asset, hr, max(k) AS k FROM v_signal GROUP BY 1, 2), g AS (SELECT symbol, unnest(range(min(hr), max(hr) + 1)) AS hr FROM v_bars_hourly GROUP BY 1)
SELECT g.symbol, g.hr, last_value(k IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g LEFT JOIN s ON g.symbol = s.asset AND g.hr = s.hr""")
def d4_join_ffill(view, table):
    """Hours without events are the gaps that are filled."""
    s = view("v_signal").groupBy(F.col("asset").alias("symbol"), "hr").agg(F.max("k").alias("k"))
    grid = S.complete_grid(view("v_bars_hourly").select("symbol", "hr"), K, "hr").select("symbol", "hr")
    return D.join_ffill(grid, s, K, "hr", ["k"])


@query("""WITH l AS (SELECT msg_id, asset, sec FROM v_signal), r AS (SELECT asset, sec, max(value) AS v FROM v_signal WHERE category = 'purchase' GROUP BY 1, 2),
c AS (SELECT msg_id, v, row_number() OVER (PARTITION BY msg_id ORDER BY abs(r.sec - l.sec), r.sec DESC) AS n FROM l JOIN r ON l.asset = r.asset AND r.sec BETWEEN l.sec - 1800 AND l.sec + 1800)
SELECT l.msg_id, v AS value FROM l LEFT JOIN c ON l.msg_id = c.msg_id AND n = 1""")
def d5_asof_nearest(view, table):
    s = view("v_signal")
    right = s.where("category = 'purchase'").groupBy("asset", "sec").agg(F.max("value").alias("value"))
    return D.asof_nearest(s.select("msg_id", "asset", "sec"), right, ["asset"], "sec", "value", 1800, 86400).select("msg_id", "value")


@query(" UNION ALL ".join(f"SELECT '{c}' AS closed, category, e AS window_end, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM v_signal, LATERAL (SELECT unnest(range(CAST(floor(sec / 3600) AS BIGINT) - 1, CAST(floor(sec / 3600) AS BIGINT) + 27)) * 3600 AS e) WHERE {w} GROUP BY 2, 3" for c, w in (("both", "sec >= e - 86400 AND sec <= e"), ("left", "sec >= e - 86400 AND sec < e"), ("right", "sec > e - 86400 AND sec <= e"))))
def d6_sliding_sums(view, table):
    """Sliding windows of each category by differences: two rows an event, not one for each of 24 windows."""
    parts = [D.sliding_sums(view("v_signal"), "sec", 86400, 3600, {"k": F.col("k")}, c, ["category"]).withColumn("closed", F.lit(c)) for c in ("both", "left", "right")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT day, volume > (SELECT avg(volume) + 1.5 * stddev_samp(volume) FROM v_bars) AS spike_1_5, symbol FROM v_bars")
def f13_market_spikes(view, table):
    """Against the mean and deviation of all symbols together."""
    return S.spike_flags(view("v_bars"), "volume", [1.5], []).select("symbol", "day", "spike_1_5")


@query(" UNION ALL ".join(f"SELECT '{c}' AS closed, e AS window_end, count(*) AS n FROM v_signal, LATERAL (SELECT unnest(range(CAST(floor(sec / 3600) AS BIGINT) - 1, CAST(floor(sec / 3600) AS BIGINT) + 27)) * 3600 AS e) WHERE {w} GROUP BY 2" for c, w in (("both", "sec >= e - 86400 AND sec <= e"), ("left", "sec >= e - 86400 AND sec < e"), ("right", "sec > e - 86400 AND sec <= e"))))
def d6_sliding_assign(view, table):
    parts = [D.sliding_sums(view("v_signal"), "sec", 86400, 3600, {}, c).withColumn("closed", F.lit(c)) for c in ("both", "left", "right")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH t AS (SELECT symbol, avg(volume) + 1.5 * stddev_samp(volume) AS least FROM v_bars GROUP BY 1), s AS (SELECT b.symbol, day FROM v_bars b JOIN t ON b.symbol = t.symbol WHERE volume > least)
SELECT DISTINCT symbol, event_id, m.day, m.day + 1 AS spike_day FROM v_mention m JOIN s ON s.day = m.day + 1""")
def d7_events_before_spikes(view, table):
    """Events the day before a spike of each symbol's volume."""
    spikes = S.spike_flags(view("v_bars"), "volume", [1.5], K).where("spike_1_5").select("symbol", "day")
    return D.events_before_spikes(view("v_mention").select("event_id", "day").distinct(), spikes, "day").select("symbol", "event_id", "day", "spike_day")


@query("SELECT x.event_id, x.entity AS a, y.entity AS b FROM (SELECT DISTINCT event_id, entity FROM v_mention) x JOIN (SELECT DISTINCT event_id, entity FROM v_mention) y ON x.event_id = y.event_id AND x.entity < y.entity")
def d8_unordered_pairs(view, table):
    return D.unordered_pairs(view("v_mention"), ["event_id"], "entity")


@query("""WITH t AS (SELECT entity FROM v_mention GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 10) SELECT entity, count(*) AS n FROM v_mention WHERE entity IN (SELECT entity FROM t) GROUP BY 1""")
def d9_restrict_topk(view, table):
    return D.restrict_topk(view("v_mention"), "entity", 10).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, entity) - 1 AS INT) AS id FROM v_mention GROUP BY 1")
def d10_entity_index(view, table):
    return D.entity_index(view("v_mention"), "entity").withColumn("id", F.col("id").cast("int"))


@query("""WITH e AS (SELECT event_id AS event, unnest(list(entity)) AS entity FROM v_mention GROUP BY 1), n AS (SELECT DISTINCT entity FROM v_mention WHERE impact >= 10 AND sentiment < 0)
SELECT event, count(*) AS n_entities, string_agg(e.entity, ',' ORDER BY e.entity) AS names FROM e JOIN n ON e.entity = n.entity GROUP BY 1""")
def d11_known_event_entities(view, table):
    m = view("v_mention")
    events = m.groupBy(F.col("event_id").alias("event")).agg(F.collect_list("entity").alias("entities"))
    return D.known_event_entities(events, m.where("impact >= 10 AND sentiment < 0").select("entity").distinct())
