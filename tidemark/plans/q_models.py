"""Queries of splits, metrics and model comparison on the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import model as M
from tidemark.operators import series as S
from tidemark.operators import stats as I
from tidemark.plans.registry import query, r6
from tidemark.scratch import materialize

K = ["cell"]
_L = "l AS (SELECT symbol AS cell, day, volume AS x, (high - low) / close AS y, close AS c FROM v_bars)"
_N = "n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM l)"
_F = "f AS (SELECT *, floor(n / 6) AS size, n - (6 - fold) * floor(n / 6) AS b FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold)), r AS (SELECT *, CASE WHEN rn <= b - 2 THEN 'train' WHEN rn > b AND rn <= b + size THEN 'test' END AS role FROM f)"


def cells(view):
    """A row a symbol and day, written: models ask for it several times, and each time would aggregate the whole of lineitem."""
    return materialize(view("v_bars"), "bars").select(F.col("symbol").alias("cell"), "day", F.col("volume").alias("x"), S.range_vol().alias("y"), F.col("close").alias("c"))


def folds(view):
    return M.walk_forward(cells(view), 5, K, "day", gap=2)


def features(view):
    """One row a cell and day: lagged features and the next day's range as y."""
    d = cells(view)
    return d.select("cell", "day", F.col("y").alias("own"), "x", "c", S.rolling_mean("y", 5, K, "day").alias("ma5"), S.forward_value("y", 1, K, "day").alias("y")).where("y IS NOT NULL")


def predictions(view):
    """The mean of the last five values as prediction, on test rows."""
    d = cells(view).withColumns({"prediction": S.rolling_mean("y", 5, K, "day"), "y": S.forward_value("y", 1, K, "day")}).where("y IS NOT NULL")
    return M.walk_forward(d, 5, K, "day").where("role = 'test'")


_P = f"WITH {_L}, q AS (SELECT cell, day, avg(y) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p, lead(y) OVER (PARTITION BY cell ORDER BY day) AS y FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM q WHERE y IS NOT NULL), t AS (SELECT * FROM (SELECT *, floor(n / 6) AS size, n - (6 - fold) * floor(n / 6) AS b FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold)) WHERE rn > b AND rn <= b + size)"


@query(f"WITH {_L}, {_N} SELECT cell, day, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split FROM n")
def j1_time_split(view, table):
    return M.time_split(cells(view), 0.8, K, "day").select("cell", "day", "split")


@query(f"WITH {_L}, {_N}, {_F} SELECT cell, CAST(fold AS INT) AS fold, role, count(*) AS n, min(day) AS first, max(day) AS last FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3")
def j2_walk_forward(view, table):
    return folds(view).groupBy("cell", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query(f"WITH {_L}, {_N}, {_F}, t AS (SELECT cell, fold, row_number() OVER (PARTITION BY cell, fold ORDER BY day) AS i, count(*) OVER (PARTITION BY cell, fold) AS k FROM r WHERE role = 'train') SELECT cell, CAST(fold AS INT) AS fold, CASE WHEN i <= floor(CAST(0.85 AS DOUBLE) * k) THEN 'fit' ELSE 'validate' END AS part, count(*) AS n FROM t GROUP BY 1, 2, 3")
def j3_inner_tail(view, table):
    return M.inner_tail(folds(view).where("role = 'train'"), 0.85, ["cell", "fold"], "day").groupBy("cell", "fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_L}, {_N}, {_F}, s AS (SELECT cell, fold, avg(x) AS m, stddev_pop(x) AS s FROM r WHERE role = 'train' GROUP BY 1, 2) SELECT r.cell, CAST(r.fold AS INT) AS fold, day, round((x - m) / s, 6) + 0.0 AS x FROM r JOIN s ON r.cell = s.cell AND r.fold = s.fold WHERE role = 'test'")
def j4_fold_scale(view, table):
    return M.fold_scale(folds(view), ["x"], ["cell", "fold"]).where("role = 'test'").select("cell", "fold", "day", r6("x").alias("x"))


@query(f"WITH {_L}, {_N}, {_F}, e AS (SELECT cell, fold, min(day) FILTER (WHERE role = 'test') AS fit_at FROM r GROUP BY 1, 2) SELECT r.cell, CAST(r.fold AS INT) AS fold, count(*) AS n FROM r JOIN e ON r.cell = e.cell AND r.fold = e.fold WHERE role = 'train' AND day + 5 <= fit_at GROUP BY 1, 2")
def m6_purged_folds(view, table):
    f = folds(view)
    at = f.where("role = 'test'").groupBy("cell", "fold").agg(F.min("day").alias("fit_at"))
    rows = M.purged(f.join(at, ["cell", "fold"]).withColumn("label_at", F.col("day") + 5), "label_at", "fit_at")
    return rows.where("role = 'train'").groupBy("cell", "fold").agg(F.count(F.lit(1)).alias("n"))


def _one_feature(rows: str, features, key="cell", order="day"):
    """SQL of unpenalised fits on single features in walk-forward folds: s has key, fold, features, n_test, mse, r2. ``rows``
    defines q with the key, the order, the features and y."""
    parts = " UNION ALL ".join(f"SELECT {key}, fold, '{c}' AS features, {c} AS v, y, rn <= b AS tr, rn > b AND rn <= b + size AS te FROM f" for c in features)
    return f"""WITH {rows}, n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM q WHERE y IS NOT NULL),
f AS (SELECT *, floor(n / 6) AS size, n - (6 - fold) * floor(n / 6) AS b FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold)), z AS ({parts}),
c AS (SELECT {key}, fold, features, regr_slope(y, v) FILTER (WHERE tr) AS slope, regr_intercept(y, v) FILTER (WHERE tr) AS icpt FROM z GROUP BY 1, 2, 3),
s AS (SELECT z.{key}, CAST(z.fold AS INT) AS fold, z.features, count(*) AS n_test, avg(power(y - icpt - slope * v, 2)) AS mse, 1 - sum(power(y - icpt - slope * v, 2)) / (var_pop(y) * count(*)) AS r2
FROM z JOIN c ON z.{key} = c.{key} AND z.fold = c.fold AND z.features = c.features WHERE te GROUP BY 1, 2, 3)"""


_Q = f"{_L}, q AS (SELECT cell, day, y AS own, x, lead(y) OVER (PARTITION BY cell ORDER BY day) AS y FROM l)"


@query(f"{_one_feature(_Q, ['own'])} SELECT cell, fold, n_test AS n, round(mse, 4) + 0.0 AS mse, round(r2, 4) + 0.0 AS r2 FROM s")
def j5_linear_one_feature(view, table):
    rows = M.walk_forward(features(view), 5, K, "day")
    m = M.regression_metrics(M.fit_predict(rows, ["own"], "y", "linear", K), ["cell", "fold"])
    return m.select("cell", "fold", "n", r6("mse", 4).alias("mse"), r6("r2", 4).alias("r2"))


@query(f"{_one_feature(_Q, ['own'])} SELECT cell, fold, n_test, round(mse, 4) + 0.0 AS mse, round(r2, 4) + 0.0 AS r2 FROM s")
def j6_unpenalised(view, table):
    out = M.nested_linear_cv(features(view), ["own"], "y", "day", [0.0], keys=K)
    return out.select("cell", "fold", "n_test", r6("mse", 4).alias("mse"), r6("r2", 4).alias("r2"))


@query(f"{_one_feature(_Q, ['own', 'x'])} SELECT cell, fold, features, 'ols' AS model, n_test, round(mse, 4) + 0.0 AS mse, round(r2, 4) + 0.0 AS r2 FROM s")
def j14_single_features(view, table):
    out = M.linear_ablation(features(view), {"own": ["own"], "x": ["x"]}, "y", "day", [0.0], keys=K, models={"ols": 0.0})
    return out.select("cell", "fold", "features", "model", "n_test", r6("mse", 4).alias("mse"), r6("r2", 4).alias("r2"))


@query(None)
def j5_linear_models(view, table):
    rows = M.walk_forward(features(view), 5, K, "day")
    out = None
    for kind in ("linear", "lasso", "ridge", "elastic"):
        m = M.regression_metrics(M.fit_predict(rows, ["own", "x", "ma5"], "y", kind, K), ["cell", "fold"]).withColumn("model", F.lit(kind))
        out = m if out is None else out.unionByName(m)
    return out.select("cell", "model", "fold", "n", r6("r2", 4).alias("r2"), r6("mse").alias("mse"))


@query(None)
def j6_nested_linear_cv(view, table):
    out = M.nested_linear_cv(features(view), ["own", "x", "c", "ma5"], "y", "day", [10 ** (-4 + 5 * i / 49) for i in range(50)], keys=K)
    return out.select("cell", "fold", r6("alpha").alias("alpha"), "n_test", r6("mse").alias("mse"), r6("r2", 4).alias("r2"))


@query(None)
def j7_tree_models(view, table):
    rows = M.walk_forward(features(view), 5, K, "day")
    parts = [M.regression_metrics(M.fit_predict(rows, ["own", "x", "ma5"], "y", k, K), ["cell", "fold"]).withColumn("model", F.lit(k)) for k in ("forest", "boosting")]
    return parts[0].unionByName(parts[1]).select("cell", "model", "fold", "n", r6("r2", 4).alias("r2"))


@query(None)
def j8_spike_classifier(view, table):
    d = S.spike_flags(features(view), "y", [1.5], K).withColumn("label", F.col("spike_1_5").cast("double"))
    preds = M.fit_spike_classifier(M.walk_forward(d, 5, K, "day"), ["own", "x", "ma5"], "label", K)
    return M.classification_metrics(preds, ["cell", "fold"]).select("cell", "fold", "n", *[r6(c, 4).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query(f"{_P}, m AS (SELECT cell, fold, count(*) AS n, 1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(power(y - p, 2)) AS mse, avg(abs(y - p)) AS mae FROM t GROUP BY 1, 2) SELECT cell, round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(mse), 4) AS mse_mean, round(avg(mae), 6) AS mae_mean FROM m GROUP BY 1")
def j9_regression_metrics(view, table):
    m = M.over_folds(M.regression_metrics(predictions(view), ["cell", "fold"]), ["cell"], ["r2", "mse", "mae"])
    return m.select("cell", r6("r2_mean").alias("r2_mean"), r6("r2_std").alias("r2_std"), r6("mse_mean", 4).alias("mse_mean"), r6("mae_mean").alias("mae_mean"))


@query("""WITH l AS (SELECT asset AS cell, CAST(k >= 70 AS INT) AS y, CAST(value > 250 AS INT) AS prediction, floor(value / 5) AS score FROM v_signal),
k AS (SELECT *, rank() OVER (PARTITION BY cell ORDER BY score) + (count(*) OVER (PARTITION BY cell, score) - 1) / 2 AS r FROM l),
g AS (SELECT cell, count(*) AS n, sum(y) AS n1, sum(y * prediction) AS tp, sum(prediction) AS p, sum(r * y) AS s FROM k GROUP BY 1)
SELECT cell, n, round(tp / p, 6) AS precision, round(tp / n1, 6) AS recall, round(2 * tp / (p + n1), 6) AS f1, round((s - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc FROM g""")
def j10_classification_metrics(view, table):
    l = view("v_signal").select(F.col("asset").alias("cell"), (F.col("k") >= 70).cast("int").alias("y"), (F.col("value") > 250).cast("int").alias("prediction"), F.floor(F.col("value") / 5).alias("score"))  # noqa: E741
    return M.classification_metrics(l, K).select("cell", "n", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query(f"WITH {_L}, d AS (SELECT cell, c - lag(c) OVER w AS p, lead(c) OVER w - c AS y FROM l WINDOW w AS (PARTITION BY cell ORDER BY day)) SELECT cell, round(avg(CAST((y > 0) = (p > 0) AS INT)), 6) AS accuracy FROM d GROUP BY 1")
def j11_directional_accuracy(view, table):
    d = cells(view).select("cell", S.diff("c", 1, K, "day").alias("prediction"), S.forward_change("c", 1, K, "day").alias("y"))
    return M.directional_accuracy(d, K).withColumn("accuracy", r6("accuracy"))


_FEATS = ["volume", "open", "high", "low"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT symbol AS target, '{f}' AS feature, corr({f}, close) AS r FROM v_bars GROUP BY 1" for f in _FEATS) + "), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, feature) AS i FROM c) SELECT target, CAST(s AS INT) AS size, string_agg(feature, ',' ORDER BY i) AS features FROM k CROSS JOIN (SELECT unnest([2, 3]) AS s) WHERE i <= s GROUP BY 1, 2")
def j12_feature_sets(view, table):
    long = view("v_bars").select(F.col("symbol").alias("target"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col("close").alias("y")) for f in _FEATS])))
    return M.feature_sets(I.pearson_cells(long, ["target", "feature"]), [2, 3])


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT symbol AS target, '{f}' AS feature, count(*) AS n, corr({f}, close) AS r FROM v_bars GROUP BY 1" for f in _FEATS) + """)
SELECT target, feature, n, round(r, 6) + 0.0 AS r, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, feature) AS rank FROM c""")
def j12_ranked_features(view, table):
    """Features by |r|; the significance by false discovery rate is tested against its definition."""
    long = view("v_bars").select(F.col("symbol").alias("target"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col("close").alias("y")) for f in _FEATS])))
    return M.ranked_features(I.pearson_cells(long, ["target", "feature"])).select("target", "feature", "n", r6("r").alias("r"), "rank")


@query(None)
def j12_significant_features(view, table):
    """The same with p, q and the flag."""
    long = view("v_bars").select(F.col("symbol").alias("target"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col("close").alias("y")) for f in _FEATS])))
    return M.ranked_features(I.pearson_cells(long, ["target", "feature"])).select("target", "feature", r6("p").alias("p"), r6("q").alias("q"), "significant")


@query(None)
def j13_top_coefficients(view, table):
    fit = M.regressor("forest", "y").trees(features(view), ["own", "x", "c", "ma5"], K)
    return M.top_coefficients(fit).select("cell", "feature", r6("value", 4).alias("value"))


_SETS = {"Baseline": ["own"], "Volume": ["x"], "Combined": ["own", "x", "ma5"]}


@query(None)
def j14_ablation(view, table):
    return M.ablation(features(view), _SETS, ["linear", "lasso"], "y", 5, "day", K).select("cell", "features", "model", "fold", "n", r6("r2", 4).alias("r2"))


_HUBS = ("e1", "e2", "e3")


def graph_features(view):
    """A row for each symbol and day: own volatility, the mentions' sentiment and volume for the symbol, the day's graph
    numbers, and how often each hub is mentioned; 0 on days without mentions."""
    m = view("v_mention")
    sentiment = m.groupBy(F.col("category").alias("cell"), "day").agg((F.sum(F.col("sentiment") * F.col("impact")) / F.sum("impact")).alias("sentiment"), F.count(F.lit(1)).alias("volume"))
    graph = G.daily_degree(m).select("day", "entities", "avg_degree", "std_degree")
    hubs = m.groupBy("day").agg(*[F.count_if(F.col("entity") == h).alias(h) for h in _HUBS])
    d = cells(view).select("cell", "day", F.col("y").alias("own"), "x").join(sentiment, ["cell", "day"], "left").join(graph, "day", "left").join(hubs, "day", "left")
    return d.fillna(0, ["sentiment", "volume", "entities", "avg_degree", "std_degree", *_HUBS])


_SENTIMENT, _GRAPH = ["own", "sentiment", "volume"], ["own", "entities", "avg_degree", "std_degree"]
_ABLATED = {"Baseline": ["own"], "Sentiment": _SENTIMENT, "Graph": _GRAPH, "Hubs": ["own", *_HUBS], "Combined": [*_SENTIMENT, *_GRAPH[1:], *_HUBS]}


_H = f"{_L}, q AS (SELECT cell || '/' || h AS cell, day, y AS own, x, CASE h WHEN 1 THEN lead(y, 1) OVER w WHEN 5 THEN lead(y, 5) OVER w ELSE lead(y, 20) OVER w END AS y FROM l CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) WINDOW w AS (PARTITION BY cell, h ORDER BY day))"


@query(f"{_one_feature(_H, ['own', 'x'])}, m AS (SELECT cell, features, avg(r2) AS r2 FROM s GROUP BY 1, 2) SELECT split_part(a.cell, '/', 1) AS cell, CAST(split_part(a.cell, '/', 2) AS INT) AS horizon, round(a.r2, 4) + 0.0 AS base_r2, round(b.r2, 4) + 0.0 AS r2, round(b.r2 - a.r2, 4) + 0.0 AS delta FROM m a JOIN m b ON a.cell = b.cell AND a.features = 'own' AND b.features = 'x'")
def j15_single_features(view, table):
    rows = cells(view).select("cell", "day", F.col("y").alias("own"), "x")
    out = M.horizon_sweep(rows, ["own"], ["x"], "own", (1, 5, 20), "day", [0.0], K)
    return out.select("cell", "horizon", *[r6(c, 4).alias(c) for c in ("base_r2", "r2", "delta")])


@query(None)
def j14_ablation_sets(view, table):
    """Baseline, Sentiment, Graph, Hubs and Combined on the same rows, with ridge and lasso."""
    rows = materialize(graph_features(view).withColumn("y", S.forward_value("own", 1, K, "day")), "features")
    return M.linear_ablation(rows, _ABLATED, "y", "day", [0.001, 0.01, 0.1], keys=K).select("cell", "features", "model", "fold", "n_test", r6("mse").alias("mse"), r6("r2", 4).alias("r2"))


@query(None)
def j15_horizons_against_baseline(view, table):
    """Horizons from 1 to 72 days, the combined features against the series' own value."""
    out = M.horizon_sweep(graph_features(view), ["own"], _ABLATED["Combined"], "own", (1, 2, 3, 6, 12, 24, 48, 72), "day", [0.001, 0.01, 0.1], K)
    return out.select("cell", "horizon", *[r6(c, 4).alias(c) for c in ("base_r2", "r2", "delta")])


_A = """g AS (SELECT asset AS symbol, hr, sum(sentiment * impact) / sum(impact) AS sentiment, CAST(count(*) AS DOUBLE) AS volume FROM v_signal GROUP BY 1, 2),
j AS (SELECT g.symbol, g.hr, sentiment, g.volume, (high - low) / close AS own FROM g JOIN v_bars_hourly b ON g.symbol = b.symbol AND g.hr = b.hr),
q AS (SELECT *, lead(own) OVER (PARTITION BY symbol ORDER BY hr) AS y FROM j)"""


def asset_rows(view):
    f = view("v_signal").groupBy(F.col("asset").alias("symbol"), "hr").agg((F.sum(F.col("sentiment") * F.col("impact")) / F.sum("impact")).alias("sentiment"), F.count(F.lit(1)).cast("double").alias("volume"))
    rows = f.join(view("v_bars_hourly").drop("volume"), ["symbol", "hr"]).withColumn("own", S.range_vol())
    return materialize(rows.withColumn("y", S.forward_value("own", 1, ["symbol"], "hr")).where("y IS NOT NULL"), "assets")


@query(f"{_one_feature(_A, ['sentiment', 'own'], 'symbol', 'hr')} SELECT symbol, features, count(*) AS folds, round(avg(mse), 4) + 0.0 AS mse, round(avg(r2), 4) + 0.0 AS r2 FROM s GROUP BY 1, 2")
def j17_asset_single_features(view, table):
    """Messages to features to bars to models for every asset, on single features."""
    fits = M.linear_ablation(asset_rows(view), {"sentiment": ["sentiment"], "own": ["own"]}, "y", "hr", [0.0], keys=["symbol"], models={"ols": 0.0})
    return fits.groupBy("symbol", "features").agg(F.count(F.lit(1)).alias("folds"), r6(F.avg("mse"), 4).alias("mse"), r6(F.avg("r2"), 4).alias("r2"))


@query(None)
def j17_asset_models(view, table):
    """Messages to features to bars to screen to models for every asset: features that the screen ranks, fitted by nested folds."""
    rows = asset_rows(view)
    names = ["sentiment", "volume", "own"]
    long = rows.select("symbol", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names])))
    screen = I.pearson_cells(long, ["symbol", "feature"]).groupBy("symbol").agg(F.max_by("feature", F.struct(F.abs("r"), "feature")).alias("strongest"))
    fits = M.linear_ablation(rows, {"Baseline": ["own"], "Sentiment": ["sentiment", "volume"], "Combined": names}, "y", "hr", [0.001, 0.01, 0.1], keys=["symbol"], models={"lasso": 1.0})
    means = fits.groupBy("symbol", "features").agg(F.count(F.lit(1)).alias("folds"), r6(F.avg("mse")).alias("mse"), r6(F.avg("r2"), 4).alias("r2"))
    return means.join(screen, "symbol")


@query(None)
def j15_horizon_sweep(view, table):
    d = cells(view)
    out = None
    for h in (1, 5, 10):
        rows = d.select("cell", "day", F.col("y").alias("own"), "x", S.forward_value("y", h, K, "day").alias("y")).where("y IS NOT NULL")
        m = M.nested_linear_cv(rows, ["own", "x"], "y", "day", [0.001, 0.01, 0.1], keys=K).withColumn("horizon", F.lit(h))
        out = m if out is None else out.unionByName(m)
    return out.groupBy("cell", "horizon").agg(r6(F.avg("r2"), 4).alias("r2"))


@query(f"""WITH {_L}, {_N}, s AS (SELECT *, rn <= floor(CAST(0.7 AS DOUBLE) * n) AS tr FROM n), z AS (SELECT cell, 'x' AS feature, tr, x AS v, y FROM s UNION ALL SELECT cell, 'c', tr, c, y FROM s),
g AS (SELECT cell, feature, count(*) FILTER (WHERE tr) AS n, avg(v) FILTER (WHERE tr) AS mx, avg(y) FILTER (WHERE tr) AS my, var_pop(v) FILTER (WHERE tr) AS vx, covar_pop(v, y) FILTER (WHERE tr) AS c FROM z GROUP BY 1, 2),
b AS (SELECT cell, feature, c / (vx + 1.0 / n) AS slope, my - c / (vx + 1.0 / n) * mx AS icpt FROM g)
SELECT b.cell, b.feature, round(slope, 6) + 0.0 AS slope, round(1 - avg(power(y - icpt - slope * v, 2)) FILTER (WHERE tr) / var_pop(y) FILTER (WHERE tr), 5) + 0.0 AS train_r2,
round(1 - avg(power(y - icpt - slope * v, 2)) FILTER (WHERE NOT tr) / var_pop(y) FILTER (WHERE NOT tr), 5) + 0.0 AS test_r2 FROM z JOIN b ON z.cell = b.cell AND z.feature = b.feature GROUP BY b.cell, b.feature, slope""")
def j16_univariate_fit(view, table):
    d = M.time_split(cells(view), 0.7, K, "day")
    return M.univariate_fit(d, ["x", "c"], "y", 1.0, K).select("cell", "feature", r6("slope").alias("slope"), r6("train_r2", 5).alias("train_r2"), r6("test_r2", 5).alias("test_r2"))


@query(f"""WITH f AS (SELECT asset AS symbol, hr, sum(sentiment * impact) / sum(impact) AS s, count(*) AS n FROM v_signal GROUP BY 1, 2),
j AS (SELECT f.symbol, f.hr, s, n, (high - low) / close AS v FROM f JOIN v_bars_hourly b ON f.symbol = b.symbol AND f.hr = b.hr),
x AS (SELECT symbol, 'sentiment' AS feature, s AS x, lead(v) OVER (PARTITION BY symbol ORDER BY hr) AS y FROM j UNION ALL SELECT symbol, 'volume', n, lead(v) OVER (PARTITION BY symbol ORDER BY hr) FROM j)
SELECT symbol, feature, count(y) AS n, round(corr(x, y), 6) + 0.0 AS r FROM x GROUP BY 1, 2""")
def j17_all_assets(view, table):
    """Messages to features to bars to screen for every asset in one plan: the asset is a column."""
    f = view("v_signal").groupBy(F.col("asset").alias("symbol"), "hr").agg((F.sum(F.col("sentiment") * F.col("impact")) / F.sum("impact")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    j = f.join(view("v_bars_hourly"), ["symbol", "hr"]).withColumn("v", S.range_vol())
    y = S.forward_value("v", 1, ["symbol"], "hr")
    long = j.withColumn("y", y).select("symbol", "y", F.inline(F.array(F.struct(F.lit("sentiment").alias("feature"), F.col("s").alias("x")), F.struct(F.lit("volume").alias("feature"), F.col("n").alias("x")))))
    return I.pearson_cells(long, ["symbol", "feature"]).select("symbol", "feature", "n", r6("r").alias("r"))


@query(None)
def j18_pca_project(view, table):
    out = M.pca_project(table("embeddings"), "embedding", 8, F.col("vec_id") % 2 == 0)
    return out.select("vec_id", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT d, avg(v) AS m FROM v WHERE vec_id % 2 = 0 GROUP BY 1) SELECT vec_id, round(sum(power(v - m, 2)), 4) AS length FROM v JOIN m ON v.d = m.d GROUP BY 1""")
def j18_pca_lengths(view, table):
    """Squared length of each vector's projection on all components: a turn keeps it, so it is that of the centred vector."""
    d = table("embeddings")
    out = M.pca_project(d, "embedding", d.select(F.max(F.size("embedding"))).first()[0], F.col("vec_id") % 2 == 0)
    return out.select("vec_id", r6(F.aggregate("projected", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


_M = f"{_P}, m AS (SELECT CASE WHEN fold % 2 = 0 THEN 'even' ELSE 'odd' END AS features, cell AS model, 1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(power(y - p, 2)) AS mse FROM t GROUP BY 1, 2)"


def _metrics(view):
    p = predictions(view).withColumns({"features": F.when(F.col("fold") % 2 == 0, "even").otherwise("odd"), "model": F.col("cell")})
    return M.regression_metrics(p, ["features", "model"])


@query(f"{_M} SELECT m.features, m.model, round(m.r2 - b.r2, 6) + 0.0 AS r2_gain, round(100 * (b.mse - m.mse) / b.mse, 4) + 0.0 AS mse_cut FROM m JOIN m b ON m.model = b.model AND b.features = 'odd'")
def j19_lift(view, table):
    return M.lift(_metrics(view), "odd").select("features", "model", r6("r2_gain").alias("r2_gain"), r6("mse_cut", 4).alias("mse_cut"))


@query(f"{_M} SELECT features, model, round(r2, 6) + 0.0 AS r2 FROM m ORDER BY r2 DESC, features, model LIMIT 4")
def j20_leaderboard(view, table):
    return M.leaderboard(_metrics(view), 4).select("features", "model", r6("r2").alias("r2"))


@query(f"{_P} SELECT round(avg(abs(y - p) - abs(y)), 6) + 0.0 AS mean FROM t")
def m8_paired_difference(view, table):
    """The mean that the interval of m8 is around."""
    return _bootstrap(view).select(r6("mean").alias("mean"))


def _bootstrap(view):
    p = predictions(view).withColumns({"a": F.abs(F.col("y") - F.col("prediction")), "b": F.abs(F.col("y"))})
    return M.block_bootstrap(p, "a", "b", "day", 20, 500)


@query(None)
def m8_block_bootstrap(view, table):
    out = _bootstrap(view)
    return out.select(*[r6(c, 4).alias(c) for c in ("mean", "lo", "hi")])
