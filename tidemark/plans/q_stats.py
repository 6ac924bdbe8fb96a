"""Queries of the association statistics: cells are symbols of the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators import stats as I
from tidemark.plans.registry import query, r6

K = ["cell"]
_L = "l AS (SELECT symbol AS cell, day, volume AS x, (high - low) / close AS y, close FROM v_bars)"


def cells(view):
    return view("v_bars").select(F.col("symbol").alias("cell"), "day", F.col("volume").alias("x"), S.range_vol().alias("y"), "close")


@query(f"WITH {_L} SELECT cell, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM l GROUP BY 1")
def i1_pearson(view, table):
    return I.pearson_cells(cells(view), K).select("cell", "n", r6("r").alias("r"))


_RANK = "k AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2 AS x, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2 AS y FROM l)"


@query(f"WITH {_L}, {_RANK} SELECT cell, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM k GROUP BY 1")
def i2_spearman(view, table):
    return I.spearman_cells(cells(view), K).select("cell", "n", r6("r").alias("r"))


@query("""WITH l AS (SELECT asset AS cell, msg_id, k AS x, floor(value / 10) AS y FROM v_signal),
s AS (SELECT a.cell, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (WHERE a.x <> b.x) AS nx, count(*) FILTER (WHERE a.y <> b.y) AS ny FROM l a JOIN l b ON a.cell = b.cell AND a.msg_id < b.msg_id GROUP BY 1)
SELECT cell, round(s / sqrt(CAST(nx AS DOUBLE) * ny), 6) + 0.0 AS tau FROM s""")
def i3_kendall(view, table):
    long = view("v_signal").select(F.col("asset").alias("cell"), F.col("k").cast("double").alias("x"), F.floor(F.col("value") / 10).cast("double").alias("y"))
    return I.kendall_cells(long, K).select("cell", r6("tau").alias("tau"))


@query(f"WITH {_L} SELECT cell, count(*) AS n, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept, round(regr_r2(y, x), 6) + 0.0 AS r2 FROM l GROUP BY 1")
def i4_ols(view, table):
    return I.ols_cells(cells(view), K).select("cell", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


_LAGS = ", ".join(f"lag(z0, {j}) OVER w AS a{j}, lag(z1, {j}) OVER w AS b{j}" for j in range(1, 6))


def _s(a, b):
    names = {"0": "a", "1": "b"}
    return f"sum(z{a} * z{b})" + "".join(f" + {1 - j / 6} * (coalesce(sum(z{a} * {names[b]}{j}), 0) + coalesce(sum({names[a]}{j} * z{b}), 0))" for j in range(1, 6))


@query(f"""WITH {_L}, o AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY 1), u AS (SELECT l.cell, day, x, y - a - b * x AS z0, (y - a - b * x) * x AS z1, b FROM l JOIN o ON l.cell = o.cell),
v AS (SELECT *, {_LAGS} FROM u WINDOW w AS (PARTITION BY cell ORDER BY day)),
g AS (SELECT cell, count(*) AS n, max(b) AS slope, sum(x) AS sx, sum(x * x) AS sxx, {_s('0', '0')} AS s00, {_s('0', '1')} AS s01, {_s('1', '1')} AS s11 FROM v GROUP BY 1)
SELECT cell, n, round(slope, 6) + 0.0 AS slope, round(sqrt((sx * sx * s00 - 2 * n * sx * s01 + n * n * s11) / power(n * sxx - sx * sx, 2) * n / (n - 2)), 6) AS se FROM g""")
def i5_hac(view, table):
    return I.hac_cells(cells(view), K, "day", 5).select("cell", "n", r6("slope").alias("slope"), r6("se").alias("se"))


@query("""WITH p AS (SELECT asset, hr, (sum(k) % 997 + 1) / 1000.0 AS p FROM v_signal GROUP BY 1, 2), r AS (SELECT *, p * count(*) OVER (PARTITION BY asset) / row_number() OVER (PARTITION BY asset ORDER BY p, hr) AS raw, row_number() OVER (PARTITION BY asset ORDER BY p, hr) AS i FROM p)
SELECT asset, hr, round(least(min(raw) OVER (PARTITION BY asset ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM r""")
def i6_fdr(view, table):
    p = view("v_signal").groupBy("asset", "hr").agg(((F.sum("k") % 997 + 1) / 1000.0).alias("p"))
    return I.fdr_bh(p, ["asset"], "p", ["hr"]).select("asset", "hr", r6("q").alias("q"))


@query(None)
def i7_stationarity(view, table):
    out = I.stationarity_screen(cells(view), K, "day")
    return out.select("cell", "n", "adf_lag", "stationary", "kpss_lags", *[r6(c, 4).alias(c) for c in ("adf", "adf_critical", "adf_p", "kpss", "kpss_p")])


@query(f"""WITH {_L}, e AS (SELECT cell, y - avg(y) OVER (PARTITION BY cell) AS e, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM l),
s AS (SELECT *, sum(e) OVER (PARTITION BY cell ORDER BY rn ROWS UNBOUNDED PRECEDING) AS s FROM e), t AS (SELECT cell, max(n) AS n, sum(e * e) AS g0, sum(s * s) AS eta FROM s GROUP BY 1),
g AS (SELECT a.cell, a.rn - b.rn AS j, sum(a.e * b.e) AS g FROM e a JOIN e b ON a.cell = b.cell AND b.rn BETWEEN a.rn - 400 AND a.rn - 1 GROUP BY 1, 2),
k AS (SELECT t.cell, CAST(floor(1.1447 * power(power((sum(j * g) * 2 / max(n)) / (max(g0) / max(n) + sum(g) * 2 / max(n)), 2), 1 / 3) * power(max(n), 1 / 3)) AS INT) AS lags FROM t JOIN g ON t.cell = g.cell AND j <= floor(power(n, 2 / 9)) GROUP BY 1)
SELECT t.cell, max(lags) AS kpss_lags, round(max(eta) / (max(n) * (max(g0) + 2 * coalesce(sum(g * (1 - j / (lags + 1))) FILTER (WHERE j <= lags), 0))), 4) AS kpss FROM t JOIN k ON t.cell = k.cell LEFT JOIN g ON t.cell = g.cell GROUP BY 1""")
def i7_kpss(view, table):
    return I.kpss_screen(cells(view).where("y IS NOT NULL"), K, "day").select("cell", "kpss_lags", r6("kpss", 4).alias("kpss"))


@query(f"""WITH {_L}, d AS (SELECT cell, y - lag(y) OVER w AS d, lag(y) OVER w AS y1 FROM l WINDOW w AS (PARTITION BY cell ORDER BY day)),
r AS (SELECT cell, count(*) AS n, regr_slope(d, y1) AS b, var_pop(d) AS vd, var_pop(y1) AS vy, covar_pop(d, y1) AS c FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT cell, round(b / sqrt(n * (vd - c * c / vy) / (n - 2) / (n * vy)), 4) + 0.0 AS adf FROM r""")
def i7_adf_without_lags(view, table):
    return I.adf_screen(cells(view).where("y IS NOT NULL"), K, "day", max_lag=0).select("cell", r6("adf", 4).alias("adf"))


@query(None)
def i8_make_stationary(view, table):
    return I.make_stationary(cells(view), K, "day").groupBy("cell").agg(F.count("y").alias("n"), r6(F.avg("y")).alias("mean"))


@query(None)
def i9_granger(view, table):
    return I.granger_screen(cells(view), K, "day").select("cell", "lag", "n", r6("f", 4).alias("f"), r6("p", 4).alias("p"))


@query(f"""WITH {_L}, d AS (SELECT cell, y, lag(y) OVER w AS a, lag(x) OVER w AS b FROM l WINDOW w AS (PARTITION BY cell ORDER BY day)),
m AS (SELECT cell, count(*) AS n, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab FROM d WHERE a IS NOT NULL GROUP BY 1),
r AS (SELECT *, n * (yy - ya * ya / aa) AS own, n * (yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab)) AS both_ FROM m)
SELECT cell, n, round((own - both_) / (both_ / (n - 3)), 4) + 0.0 AS f FROM r""")
def i9_granger_one_lag(view, table):
    return I.granger_screen(cells(view), K, "day", 1).select("cell", "n", r6("f", 4).alias("f"))


@query(" UNION ALL ".join(f"""SELECT cell, {k} AS lag, n, round(pc / pf / sqrt((py - pc * pc / pf) / (n - 4) / pf), 4) + 0.0 AS t FROM (
SELECT cell, n, yf - (ya * (af * cc - cf * ac) + yc * (cf * aa - af * ac)) / det AS pc, ff - (af * (af * cc - cf * ac) + cf * (cf * aa - af * ac)) / det AS pf, yy - (ya * (ya * cc - yc * ac) + yc * (yc * aa - ya * ac)) / det AS py FROM (
SELECT *, aa * cc - ac * ac AS det FROM (SELECT cell, count(*) AS n, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(c) AS cc, var_pop(f) AS ff, covar_pop(y, a) AS ya, covar_pop(y, c) AS yc, covar_pop(y, f) AS yf, covar_pop(a, c) AS ac, covar_pop(a, f) AS af, covar_pop(c, f) AS cf
FROM (SELECT cell, y, lag(y, {k}) OVER w AS a, lag(close, {k}) OVER w AS c, lag(x, {k}) OVER w AS f FROM (SELECT symbol AS cell, day, volume AS x, (high - low) / close AS y, close FROM v_bars) WINDOW w AS (PARTITION BY cell ORDER BY day)) WHERE a IS NOT NULL GROUP BY 1)))""" for k in range(1, 8)))
def i10_controlled_t(view, table):
    """The t statistics behind i10's p values."""
    out = I.controlled_lag_regression(cells(view), K, "day", "y", "x", "close", range(1, 8))
    return out.select("cell", "lag", "n", r6("t", 4).alias("t"))


@query(None)
def i10_controlled_lags(view, table):
    out = I.controlled_lag_regression(cells(view), K, "day", "y", "x", "close", range(1, 8))
    return out.select("cell", "lag", "n", r6("p", 4).alias("p"), r6("q", 4).alias("q"))


@query(f"""WITH {_L}, g AS (SELECT cell, day % 7 AS dow, avg(x) AS x, avg(close) AS c, avg(y) AS y FROM l GROUP BY 1, 2),
z AS (SELECT l.cell, l.x - g.x AS x, l.close - g.c AS c, l.y - g.y AS y FROM l JOIN g ON l.cell = g.cell AND l.day % 7 = g.dow),
m AS (SELECT cell, count(*) AS n, sum(x * x) AS xx, sum(c * c) AS cc, sum(x * c) AS xc, sum(x * y) AS xy, sum(c * y) AS cy, sum(y * y) AS yy FROM z GROUP BY 1),
b AS (SELECT *, xx * cc - xc * xc AS det, (xy * cc - cy * xc) / (xx * cc - xc * xc) AS bx, (cy * xx - xy * xc) / (xx * cc - xc * xc) AS bc FROM m),
s AS (SELECT *, (yy - bx * xy - bc * cy) / (n - 9) AS s2 FROM b)
SELECT cell, 'x' AS term, n, round(bx / sqrt(s2 * cc / det), 4) + 0.0 AS t FROM s UNION ALL SELECT cell, 'close', n, round(bc / sqrt(s2 * xx / det), 4) + 0.0 FROM s""")
def i11_controlled_t(view, table):
    """The t statistics of the regressors beside a constant and six weekday dummies; the SQL takes weekday means off instead."""
    return _weekday_fit(view).where("term IN ('x', 'close')").select("cell", "term", "n", r6("t", 4).alias("t"))


@query(None)
def i11_controlled_ols(view, table):
    return _weekday_fit(view).select("cell", "term", "n", r6("t", 4).alias("t"), r6("p", 4).alias("p"))


def _weekday_fit(view):
    df = cells(view).withColumns({f"dow{d}": (F.col("day") % 7 == d).cast("double") for d in range(1, 7)})
    return I.regress_cells(df, K, "y", ["x", "close", *[f"dow{d}" for d in range(1, 7)]])


@query(f"WITH {_L}, o AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY 1) SELECT l.cell, count(*) AS n, round(count(*) * regr_r2(power(y - a - b * x, 2), x), 6) + 0.0 AS lm FROM l JOIN o ON l.cell = o.cell GROUP BY 1")
def i12_breusch_pagan(view, table):
    return I.breusch_pagan(cells(view), K).select("cell", "n", r6("lm").alias("lm"))


@query(f"""WITH {_L}, m AS (SELECT cell, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM l GROUP BY 1),
r AS (SELECT cell, x, y, day, row_number() OVER (PARTITION BY cell ORDER BY x, day) AS r, count(*) OVER (PARTITION BY cell) AS n FROM l),
e AS (SELECT cell, min(x) FILTER (WHERE r > floor(n * 0.01)) AS lo, max(x) FILTER (WHERE r <= n - floor(n * 0.01)) AS hi FROM r GROUP BY 1)
SELECT 'all' AS variant, cell, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM l GROUP BY 2
UNION ALL SELECT 'inliers', l.cell, count(*), round(corr(x, y), 6) + 0.0 FROM l JOIN m ON l.cell = m.cell WHERE NOT (abs(x - mx) / sx > 3 OR abs(y - my) / sy > 3) GROUP BY 2
UNION ALL SELECT 'winsorized', l.cell, count(*), round(corr(least(greatest(x, lo), hi), y), 6) + 0.0 FROM l JOIN e ON l.cell = e.cell GROUP BY 2""")
def i13_outlier_sensitivity(view, table):
    d = cells(view)
    parts = {"all": d, "inliers": S.zscore_mask(d, ["x", "y"], 3.0, K).where("NOT outlier"), "winsorized": S.winsorize(d, "x", 0.01, K, "day")}
    long = [p.select("cell", "x", "y", F.lit(v).alias("variant")) for v, p in parts.items()]
    return I.pearson_cells(long[0].unionByName(long[1]).unionByName(long[2]), ["variant", "cell"]).select("variant", "cell", "n", r6("r").alias("r"))


@query("""WITH h AS (SELECT asset, hr, sum(sentiment * impact) / sum(impact) AS x, avg(value) AS y, count(*) AS n, count(*) FILTER (WHERE is_fact) / nullif(count(is_fact), 0) AS f FROM v_signal GROUP BY 1, 2),
t AS (SELECT x, y, unnest([CASE WHEN f > 0.7 THEN 'facts' END, CASE WHEN f <= 0.5 THEN 'opinions' END, CASE WHEN n >= 5 THEN 'busy' END, CASE WHEN hr % 24 < 12 THEN 'morning' END]) AS segment FROM h)
SELECT segment, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM t WHERE segment IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""")
def i14_segments(view, table):
    h = view("v_signal").groupBy("asset", "hr").agg(
        (F.sum(F.col("sentiment") * F.col("impact")) / F.sum("impact")).alias("x"), F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"),
        (F.count_if("is_fact") / F.nullif(F.count("is_fact"), F.lit(0))).alias("f"),
    )
    seg = {"facts": F.col("f") > 0.7, "opinions": F.col("f") <= 0.5, "busy": F.col("n") >= 5, "morning": F.col("hr") % 24 < 12}
    return I.segment_correlations(h, seg).withColumn("r", r6("r"))


@query(f"WITH {_L}, c AS (SELECT cell, corr(x, y) AS r FROM l GROUP BY 1) SELECT cell, round(r * r, 6) AS r2, round(2 * r / sqrt(1 - r * r), 6) + 0.0 AS cohens_d FROM c")
def i15_effect_size(view, table):
    return I.effect_size(I.pearson_cells(cells(view), K)).select("cell", r6("r2").alias("r2"), r6("cohens_d").alias("cohens_d"))


@query(f"""WITH {_L}, s AS (SELECT cell, day, x, y, avg(x) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x7, lag(x) OVER (PARTITION BY cell ORDER BY day) AS x1 FROM l),
c AS (SELECT 'raw' AS spec, cell, corr(x, y) AS r FROM s GROUP BY 2 UNION ALL SELECT 'ma7', cell, corr(x7, y) FROM s GROUP BY 2 UNION ALL SELECT 'lag1', cell, corr(x1, y) FROM s GROUP BY 2)
SELECT cell, count(*) AS specs, round(min(r), 6) + 0.0 AS least, round(max(r), 6) + 0.0 AS most, round(quantile_cont(r, 0.5), 6) + 0.0 AS median FROM c GROUP BY 1""")
def i16_sensitivity(view, table):
    d = cells(view)
    specs = {"raw": F.col("x"), "ma7": S.rolling_mean("x", 7, K, "day"), "lag1": S.shifted("x", 1, K, "day")}
    long = [d.select(F.lit(n).alias("spec"), "cell", c.alias("x"), "y") for n, c in specs.items()]
    r = I.pearson_cells(long[0].unionByName(long[1]).unionByName(long[2]), ["spec", "cell"])
    return r.groupBy("cell").agg(F.count(F.lit(1)).alias("specs"), r6(F.min("r")).alias("least"), r6(F.max("r")).alias("most"), r6(F.percentile("r", 0.5)).alias("median"))


_SPLIT = "s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY day) <= floor(CAST(0.7 AS DOUBLE) * count(*) OVER (PARTITION BY cell)) THEN 'train' ELSE 'test' END AS split FROM l)"


def split(view):
    from tidemark.operators.model import time_split

    return time_split(cells(view), 0.7, K, "day")


@query(f"WITH {_L}, {_SPLIT}, c AS (SELECT cell, corr(x, y) FILTER (WHERE split = 'train') AS a, corr(x, y) FILTER (WHERE split = 'test') AS b FROM s GROUP BY 1) SELECT cell, round(a, 6) + 0.0 AS train_r, round(b, 6) + 0.0 AS test_r, round((abs(a) - abs(b)) / abs(a), 4) + 0.0 AS degradation, sign(a) * sign(b) < 0 AS flips FROM c")
def i17_stability(view, table):
    return I.stability(split(view), K, "split").select("cell", r6("train_r").alias("train_r"), r6("test_r").alias("test_r"), r6("degradation", 4).alias("degradation"), "flips")


@query(f"WITH {_L}, {_SPLIT}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, avg({c}) FILTER (WHERE split = 'train') AS a, avg({c}) FILTER (WHERE split = 'test') AS b, stddev_samp({c}) FILTER (WHERE split = 'train') AS c, stddev_samp({c}) FILTER (WHERE split = 'test') AS d FROM s" for c in ("x", "y")) + ") SELECT metric, round(100 * (b - a) / abs(a), 6) + 0.0 AS mean_shift, round(100 * (d - c) / abs(c), 6) + 0.0 AS std_shift FROM m")
def i18_distribution_shift(view, table):
    return I.distribution_shift(split(view), ["x", "y"], "split").withColumns({c: r6(c) for c in ("mean_shift", "std_shift")})


@query(None)
def i19_var_irf(view, table):
    return I.var_irf(cells(view), K, "day", ["x", "y"], 7, 10).withColumn("value", r6("value", 4))


@query(f"WITH {_L}, {_RANK}, a AS (SELECT cell, corr(x, y) AS p FROM l GROUP BY 1), b AS (SELECT cell, corr(x, y) AS s FROM k GROUP BY 1) SELECT a.cell, round(p, 6) + 0.0 AS pearson, round(s, 6) + 0.0 AS spearman, abs(s - p) / abs(p) < 0.1 AS linear FROM a JOIN b ON a.cell = b.cell")
def i20_linearity(view, table):
    return I.linearity_check(cells(view), K).select("cell", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), "linear")


@query(" UNION ALL ".join(f"SELECT symbol AS cell, {h} AS horizon, count(f) AS n, round(corr(volume, f), 6) + 0.0 AS r FROM (SELECT *, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY day) - close AS f FROM v_bars) GROUP BY 1" for h in (1, 3, 6, 12, 24)))
def i21_predictive(view, table):
    d = cells(view).withColumn("z", F.array(*[F.struct(F.lit(h).alias("horizon"), S.forward_change("close", h, K, "day").alias("y")) for h in (1, 3, 6, 12, 24)]))
    return I.pearson_cells(d.drop("y").select("cell", "x", F.inline("z")), ["cell", "horizon"]).select("cell", "horizon", "n", r6("r").alias("r"))


@query(f"WITH {_L}, {_SPLIT}, q AS (SELECT quantile_cont(y, 0.75) AS q FROM s WHERE split = 'train') SELECT split, count(*) AS n, round(avg(CAST(y > q AS INT)), 6) AS share FROM s, q GROUP BY 1")
def i22_regime_share(view, table):
    return I.regime_share(split(view), "y", "split").withColumn("share", r6("share"))
