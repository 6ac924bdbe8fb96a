"""Series cut into pieces, ranks from counts, communities of windows and trees of all cells, against plain forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import model as M
from tidemark.operators import ranges as R
from tidemark.operators import series as S
from tidemark.operators import stats as I
from tidemark.operators import trees as T


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice([None, rng.random(), 0.5]), rng.random()) for k, n in (("long", 900), ("short", 30), (None, 400), ("one", 1)) for t in rng.sample(range(5000), n)]
    return spark.createDataFrame(rows, "key string, t long, x double, y double").cache()


def listed(df, *by):
    return df.orderBy(*by).collect()


@pytest.mark.parametrize("least", [7, 50, 10_000])
def test_pieces_equal_one_window(series, least):
    frame = lambda d, keys: d.withColumns({"m": S.rolling_mean("y", 24, keys, "t"), "v": S.rolling_vol("y", 5, keys, "t"), "c": S.rolling_corr("x", "y", 9, keys, "t"), "f": S.forward_value("y", 3, keys, "t"), "d": S.diff("y", 2, keys, "t")})
    got = R.bounded(series, ["key"], "t", 23, 3, frame, least)
    for a, b in zip(listed(got.select("key", "t", "m", "v", "c", "f", "d"), "key", "t"), listed(frame(series, ["key"]).select("key", "t", "m", "v", "c", "f", "d"), "key", "t"), strict=True):
        assert a[:2] == b[:2] and all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))
    w = W.partitionBy("key").orderBy("t")
    want = series.withColumns({"s": F.coalesce(F.sum("y").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "l": F.last("x", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))})
    got = R.running(series, ["key"], "t", {"s": "y"}, {"l": "x"}, least)
    for a, b in zip(listed(got.select("key", "t", "l", "s"), "key", "t"), listed(want.select("key", "t", "l", "s"), "key", "t"), strict=True):
        assert a[:3] == b[:3] and abs(a.s - b.s) < 1e-9


def test_lags_in_pieces_equal_one_window(series):
    named = series.where("key IS NOT NULL").withColumnRenamed("t", "at")
    def close(a, b):
        return len(a) == len(b) > 0 and all(x[:-1] == y[:-1] and ((x[-1] is None and y[-1] is None) or abs(x[-1] - y[-1]) < 1e-9) for x, y in zip(a, b, strict=True))

    auto = [listed(S.autocorr(named, "y", [1, 4], ["key"], "at", least).select("key", "lag", "r"), "key", "lag") for least in (50, 10_000)]
    assert close(*auto)
    hac = [listed(I.hac_cells(named, ["key"], "at", 5, most=least).where("n > 2").select("key", "n", "se"), "key") for least in (50, 10_000)]
    assert close(*hac)
    risk = lambda d, by: d.select(*by, "at", "_halo", S.past_risk("y", 40, by, "at").alias("v"))
    assert close(*[listed(R.bounded(named, ["key"], "at", 40, 0, risk, least).select("key", "at", "v"), "key", "at") for least in (50, 10_000)])
    seq = lambda d, by: S.sequence_windows(d, ["y"], 2, by, "at", 1).select(*by, "at", "_halo", F.col("window")[0]["y"].alias("v"))
    assert close(*[listed(R.bounded(named, ["key"], "at", 1, 0, seq, least).select("key", "at", "v"), "key", "at") for least in (50, 10_000)])


def same(a, b, tolerance=1e-9):
    """Rows that agree, numbers up to rounding."""
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and (abs(x - y) <= tolerance * max(1.0, abs(x)) or x != x and y != y))
    return len(a) == len(b) > 0 and all(all(map(close, x, y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("least", [50, 10_000])
def test_flags_and_slices_in_pieces_equal_one_window(series, least):
    w = W.partitionBy("key").orderBy("t")
    past, week = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(-6, 0)
    want = series.withColumn("causal", F.coalesce(F.col("x") > F.avg("x").over(past) + F.stddev_samp("x").over(past), F.lit(False)))
    got = S.causal_spikes(series, "x", 1.0, ["key"], "t", least=least)
    assert got.columns == want.columns and listed(got, "key", "t") == listed(want, "key", "t")

    whole = W.partitionBy("key")
    want = series.withColumns({"bull": F.col("y") > F.avg("y").over(week), "above_median": F.col("y") > F.percentile("y", 0.5).over(whole), "high_vol": F.col("x") > F.percentile("x", 0.5).over(whole)})
    got = S.regime_flags(series, "y", "x", 7, ["key"], "t", least)
    assert listed(got.select(want.columns), "key", "t") == listed(want, "key", "t")

    size = F.greatest(F.floor(F.count(F.lit(1)).over(whole) / 4), F.lit(1))
    want = series.withColumn("slice", F.least(F.floor((F.row_number().over(w) - 1) / size), F.lit(3)).cast("int"))
    assert listed(S.consecutive_slices(series, 4, ["key"], "t", least), "key", "t") == listed(want, "key", "t")

    got = S.rebased_share(series, "y", "key", "t").select("key", "t", "index", "share")
    want = series.select("key", "t", (100 * F.col("y") / F.first("y").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("index"), (F.col("y") / F.sum("y").over(W.partitionBy("t"))).alias("share"))
    assert same(listed(got, "key", "t"), listed(want, "key", "t"))


def test_pair_correlations_in_pieces_equal_one_window(spark):
    rng = random.Random(5)
    long = spark.createDataFrame([(e, t, rng.random()) for e in "abc" for t in rng.sample(range(400), 300)], "e string, t long, r double").cache()
    a, b = (listed(S.rolling_avg_pair_corr(long, "r", 10, "e", "t", least), "t") for least in (20, 10_000))
    assert same(a, b)


def test_stationarity_and_lagged_fits_in_pieces_equal_one_window(series):
    long = series.where("key IS NOT NULL AND key <> 'one'").withColumn("x", F.coalesce("x", F.lit(0.2)))
    for screen in (
        lambda least: I.granger_screen(long, ["key"], "t", 3, least).select("key", "lag", "n", "f"),
        lambda least: I.adf_screen(long, ["key"], "t", least=least).select("key", "n", "adf_lag", "adf"),
        lambda least: I.kpss_screen(long, ["key"], "t", least).select("key", "kpss_lags", "kpss"),
        lambda least: I.controlled_lag_regression(long, ["key"], "t", "y", "x", "x", [1, 2], least).select("key", "lag", "n", "t"),
        lambda least: I.var_irf(long, ["key"], "t", ["x", "y"], 2, 3, least).select("key", "step", "impulse", "response", "value"),
    ):
        cut, whole = (sorted(map(tuple, screen(least).collect()), key=lambda r: r[:-1]) for least in (60, 10_000))
        assert same(cut, whole, 1e-6)


def test_medians_and_flags_of_empty_and_null_series(spark):
    none = spark.createDataFrame([], "key string, t long, x double")
    nulls = spark.createDataFrame([("a", t, None) for t in range(5)], "key string, t long, x double")
    assert R.key_medians(none, ["key"], {"x": "m"}).collect() == [] and S.causal_spikes(none, "x", 1.0, ["key"], "t").collect() == []
    assert [r.m for r in R.key_medians(nulls, ["key"], {"x": "m"}).collect()] == [None]
    assert {r.causal for r in S.causal_spikes(nulls, "x", 1.0, ["key"], "t", least=2).collect()} == {False}
    assert [r.causal for r in S.causal_spikes(nulls.withColumn("x", F.lit(3.7)), "x", 1.0, [], "t").collect()] == [False] * 5


@pytest.mark.parametrize("least", [11, 10_000])
def test_ranks_equal_one_window(series, least):
    want = series.select("key", "t", F.when(F.col("x").isNotNull(), I.average_rank("x", ["key"]) - F.count(F.when(F.col("x").isNull(), 1)).over(W.partitionBy("key"))).alias("x"))
    assert listed(R.average_ranks(series.select("key", "t", "x"), ["key"], ["x"], least), "key", "t") == listed(want, "key", "t")


def test_long_keys_are_cut_and_no_plan_sorts_a_whole_key(series):
    rest, long = R.cut(series, ["key"], "t", 50)
    assert {r.key for r in rest.select("key").distinct().collect()} == {"short", "one"}
    sizes = {(r.key, r._piece): r["count"] for r in long.groupBy("key", "_piece").count().collect()}
    assert len(sizes) >= 8 and max(sizes.values()) < 250
    assert R.cut(series, ["key"], "t", 10_000)[1] is None
    assert R.running(series.where("false"), ["key"], "t", {"s": "y"}).collect() == []


def best_modularity(edges):
    nodes = sorted({n for e in edges for n in e[:2]})
    m = sum(w for *_, w in edges)
    degree = {n: sum(w for a, b, w in edges for x in (a, b) if x == n) for n in nodes}
    best = -1.0
    for labels in itertools.product(range(min(4, len(nodes))), repeat=len(nodes)):
        of = dict(zip(nodes, labels, strict=True))
        q = sum(w for a, b, w in edges if of[a] == of[b]) / m - sum(sum(d for n, d in degree.items() if of[n] == c) ** 2 for c in set(labels)) / (4 * m * m)
        best = max(best, q)
    return best


def test_windows_have_near_best_communities(spark):
    rng = random.Random(8)
    windows = {w: [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations("abcdefg", 2) if rng.random() < p] or [("a", "b", 1)] for w, p in ((1, 0.3), (2, 0.5), (3, 0.8), (None, 0.4))}
    windows[4] = [("a", "b", 2)]
    e = spark.createDataFrame([(w, a, b, k) for w, es in windows.items() for a, b, k in es], "win long, src string, dst string, weight long")
    for small in (100, 0):  # each in one task, and all together in Spark
        labels = G.communities(e.where("win IS NOT NULL"), ["win"], small=small)
        q = {r.win: r.modularity for r in G.modularity(e, labels, ["win"]).collect()}
        assert set(q) == {1, 2, 3, 4}
        for w, v in q.items():
            assert v >= best_modularity(windows[w]) - 0.03
        assert labels.groupBy("win").agg(F.countDistinct("node").alias("n")).orderBy("win").collect()[3].n == 2
    found = {r.window: r for r in G.community_stats(e.withColumnRenamed("win", "window"), ["window"]).collect()}
    assert found[4].communities == 1 and abs(found[4].modularity) < 1e-12


def plain_tree(x, y, depth, least, node=1):
    """{node: (feature, cut, value)} by trying every cut."""
    value, best = y.mean(), None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= least:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
    if best is None:
        return {node: (None, None, value)}
    left = x[:, best[1]] <= best[2]
    return {node: (best[1], best[2], value), **plain_tree(x[left], y[left], depth - 1, least, 2 * node), **plain_tree(x[~left], y[~left], depth - 1, least, 2 * node + 1)}


def test_trees_equal_exhaustive_splits(spark):
    rng = np.random.default_rng(1)
    cells = {c: (rng.integers(0, 12, (60, 2)).astype(float), rng.normal(size=60).round(2)) for c in ("p", "q")}
    rows = [(c, i, *map(float, x[i]), float(y[i])) for c, (x, y) in cells.items() for i in range(60)]
    df = spark.createDataFrame([*rows, ("p", 99, None, 1.0, 1.0), ("p", 98, float("nan"), 1.0, 1.0)], "cell string, i int, a double, b double, y double")
    fit = T.fit_trees(df, ["cell"], ["a", "b"], "y", trees=1, depth=3, bins=64, least=3, bag=False)
    cuts = {r.cell: r._cuts for r in fit.cuts.collect()}
    for c, (x, y) in cells.items():
        got = {r.node: r for r in fit.nodes.where(F.col("cell") == c).collect()}
        want = plain_tree(x, y, 3, 3)
        assert set(got) == set(want)
        for n, (f, at, value) in want.items():
            assert got[n].f == f and abs(got[n].value - value) < 1e-9
            assert f is None or cuts[c][f][got[n].bin] == at
    seen = T.predict_trees(df, fit).collect()
    assert len(seen) == 120
    for r in seen:
        x, n, want = (r.a, r.b), 1, plain_tree(*cells[r.cell], 3, 3)
        while want[n][0] is not None:
            n = 2 * n + (x[want[n][0]] > want[n][1])
        assert abs(r.prediction - want[n][2]) < 1e-9


def test_forests_and_boosting_learn(spark):
    rng = random.Random(2)
    rows = [(c, f, i, "train" if i < 250 else "test", rng.uniform(-2, 2), rng.random()) for c in ("p", "q") for f in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "cell string, fold int, i int, role string, x double, noise double").withColumn("y", F.when(F.col("cell") == "p", F.sin(2 * F.col("x"))).otherwise(F.abs("x")))
    for kind in ("forest", "boosting"):
        preds = M.fit_predict(df, ["x", "noise"], "y", kind, ["cell"], rate=0.5)
        m = M.regression_metrics(preds, ["cell", "fold"]).collect()
        assert len(m) == 4 and all(r.r2 > 0.9 and r.n == 50 for r in m)
    fit = M.regressor("forest", "y").trees(df.where("role = 'train'"), ["x", "noise"], ["cell", "fold"])
    shares = {(r.cell, r.fold, r.feature): r.value for r in M.top_coefficients(fit).collect()}
    assert len(shares) == 8 and all((v > 0.8) == (k[2] == "x") for k, v in shares.items())
    labelled = df.withColumn("label", (F.col("x") > 1.2).cast("double"))
    m = M.classification_metrics(M.fit_spike_classifier(labelled, ["x", "noise"], "label", ["cell"]), ["cell", "fold"]).collect()
    assert len(m) == 4 and all(r.auc > 0.95 and r.f1 > 0.8 for r in m)


def test_linear_folds_equal_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = x @ [1.5, -2.0] + 0.3 + rng.normal(size=80) / 10
    df = spark.createDataFrame([("c", 1, "train" if i < 60 else "test", *map(float, x[i]), float(y[i])) for i in range(80)], "cell string, fold int, role string, a double, b double, y double")
    got = {(r.a, r.b): r.prediction for r in M.fit_predict(df, ["a", "b"], "y", "linear", ["cell"]).collect()}
    a = np.hstack([np.ones((80, 1)), x])
    beta = np.linalg.lstsq(a[:60], y[:60], rcond=None)[0]
    assert len(got) == 20 and all(abs(got[tuple(map(float, x[i]))] - a[i] @ beta) < 1e-8 for i in range(60, 80))
    z = (x[:60] - x[:60].mean(0)) / x[:60].std(0)
    ridge = np.linalg.solve(z.T @ z + 60 * 0.5 * np.eye(2), z.T @ (y[:60] - y[:60].mean()))
    got = {(r.a, r.b): r.prediction for r in M.fit_predict(df, ["a", "b"], "y", "ridge", ["cell"], alpha=0.5).collect()}
    assert all(abs(got[tuple(map(float, x[i]))] - (y[:60].mean() + (x[i] - x[:60].mean(0)) / x[:60].std(0) @ ridge)) < 1e-8 for i in range(60, 80))


def test_unsettled_descent_raises():
    g = np.array([[1.0, 0.999999999], [0.999999999, 1.0]]) * 100
    with pytest.raises(RuntimeError):
        M.coordinate_descent(g, np.array([100.0, 40.0]), 100, 1e-9, 0.5, np.zeros(2), rounds=3)
