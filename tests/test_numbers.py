"""Statistics, models and graph measures against plain NumPy and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hooks
from tidemark.operators import graph as G
from tidemark.operators import joins as D
from tidemark.operators import model as M
from tidemark.operators import stats as I


def ols(y, x):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, float(((y - x @ beta) ** 2).sum())


def plain_adf(y, most):
    d = np.diff(y)

    def rows(p, start):
        at = range(start, len(d))
        return np.array([d[t] for t in at]), np.array([[1.0, y[t], *(d[t - j] for j in range(1, p + 1))] for t in at])

    def aic(p):
        a, x = rows(p, most)
        return len(a) * math.log(ols(a, x)[1] / len(a)) + 2 * (2 + p)

    p = min(range(most + 1), key=aic)
    a, x = rows(p, p)
    beta, rss = ols(a, x)
    return p, beta[1] / math.sqrt(rss / (len(a) - 2 - p) * np.linalg.inv(x.T @ x)[1, 1])


def test_adf_follows_the_lag_rule(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=420)
    series = {"noise": noise, "walk": np.cumsum(noise)[:300], "ar": np.zeros(260), "short": noise[:12]}
    for t in range(6, 260):
        series["ar"][t] = 0.5 * series["ar"][t - 1] + 0.3 * series["ar"][t - 6] + noise[t]
    df = spark.createDataFrame([(c, i, float(v)) for c, y in series.items() for i, v in enumerate(y)], "cell string, t int, y double")
    got = {r.cell: r for r in I.adf_screen(df, ["cell"], "t").collect()}
    for c, y in series.items():
        most = max(0, min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2))
        p, t = plain_adf(y, most)
        assert got[c].n == len(y) and got[c].adf_lag == p and abs(got[c].adf - t) < 1e-6 * max(1, abs(t)), c
    assert got["noise"].adf_p < 0.001 < got["walk"].adf_p
    assert abs(I.adf_pvalue(-2.86154) - 0.05) < 0.001 and abs(I.adf_pvalue(-3.43035) - 0.01) < 0.001


def test_kpss_lags_follow_the_series(spark):
    rng = np.random.default_rng(9)
    series = {"noise": rng.normal(size=500), "walk": np.cumsum(rng.normal(size=400))}
    df = spark.createDataFrame([(c, i, float(v)) for c, y in series.items() for i, v in enumerate(y)], "cell string, t int, y double")
    for r in I.kpss_screen(df, ["cell"], "t").collect():
        y = series[r.cell]
        e, n = y - y.mean(), len(y)
        g = lambda j: float(e[j:] @ e[: n - j])
        few = int(n ** (2 / 9))
        s0, s1 = g(0) / n + sum(2 * g(j) / n for j in range(1, few + 1)), sum(2 * j * g(j) / n for j in range(1, few + 1))
        lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
        s2 = g(0) + 2 * sum((1 - j / (lags + 1)) * g(j) for j in range(1, lags + 1))
        assert r.kpss_lags == lags and abs(r.kpss - float((np.cumsum(e) ** 2).sum()) / (n * s2)) < 1e-9


def test_granger_of_every_lag(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=150)
    y = np.concatenate([[0.0], 0.6 * x[:-1]]) + rng.normal(size=150)
    df = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "cell string, t int, x double, y double")
    for r in I.granger_screen(df, ["cell"], "t", 5).collect():
        p, at = r.lag, range(r.lag, 150)
        own = np.array([[1.0, *(y[t - j] for j in range(1, p + 1))] for t in at])
        both = np.hstack([own, [[x[t - j] for j in range(1, p + 1)] for t in at]])
        a, b = ols(y[p:], own)[1], ols(y[p:], both)[1]
        f = (a - b) / p / (b / (150 - p - 2 * p - 1))
        assert r.n == 150 - p and abs(r.f - f) < 1e-6 * f


def test_responses_of_a_vector_autoregression(spark):
    rng = np.random.default_rng(4)
    z = np.zeros((200, 2))
    for t in range(1, 200):
        z[t] = [0.5 * z[t - 1, 0] + 0.2 * z[t - 1, 1], 0.3 * z[t - 1, 1]] + rng.normal(size=2)
    df = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(z)], "cell string, t int, a double, b double")
    got = {(r.step, r.impulse, r.response): r.value for r in I.var_irf(df, ["cell"], "t", ["a", "b"], 1, 4).collect()}
    x = np.hstack([np.ones((199, 1)), z[:-1]])
    m = np.stack([ols(z[1:, k], x)[0][1:] for k in range(2)])
    for h in range(5):
        power = np.linalg.matrix_power(m, h)
        assert all(abs(got[h, "ab"[i], "ab"[j]] - power[j, i]) < 1e-9 for i in range(2) for j in range(2))


def test_nested_folds_are_those_of_walk_forward(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(101, 2))
    y = x @ [2.0, -1.0] + 0.1 * rng.normal(size=101)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "t int, a double, b double, y double")
    tests = {r.fold: r.n for r in M.walk_forward(df, 5, [], "t").where("role = 'test'").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    grid = [0.5, 0.01]

    def ridge(a, b, alpha):
        mean, sd, mid = a.mean(0), a.std(0), b.mean()
        z = (a - mean) / sd
        beta = np.linalg.solve(z.T @ z / len(a) + alpha * np.eye(2), z.T @ (b - mid) / len(a)) / sd
        return beta, mid - beta @ mean

    for r in M.nested_linear_cv(df, ["a", "b"], "y", "t", grid, l1=0.0).collect():
        begin = 101 - (6 - r.fold) * (101 // 6)
        step, errors = begin // 4, []
        for alpha in sorted(grid, reverse=True):
            e = 0.0
            for j in (1, 2, 3):
                cut = begin - (4 - j) * step
                beta, c = ridge(x[:cut], y[:cut], alpha)
                e += ((y[cut : cut + step] - x[cut : cut + step] @ beta - c) ** 2).mean()
            errors.append((e, alpha))
        assert r.alpha == min(errors)[1] and r.n_test == tests[r.fold]
        beta, c = ridge(x[:begin], y[:begin], r.alpha)
        test = slice(begin, begin + 101 // 6)
        assert np.allclose(r.betas, beta, atol=1e-6) and abs(r.mse - ((y[test] - x[test] @ beta - c) ** 2).mean()) < 1e-6


def test_projection_is_that_of_the_singular_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = np.array([r.projected for r in M.pca_project(df, "v", 2, F.col("i") < 60).orderBy("i").collect()])
    c = x - x[:60].mean(0)
    axes = np.linalg.svd(c[:60], full_matrices=False)[2][:2]
    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(got, c @ axes.T, atol=1e-8)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(11)
    d = rng.normal(0.5, 1.0, 600)
    df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(d)], "t int, a double, b double")
    r = M.block_bootstrap(df, "a", "b", "t", 10, 800).first()
    se = np.std([d[i : i + 10].mean() for i in range(0, 600, 10)]) / math.sqrt(60)
    assert abs(r.mean - d.mean()) < 1e-9 and abs(r.lo - (r.mean - 1.96 * se)) < 0.6 * se and abs(r.hi - (r.mean + 1.96 * se)) < 0.6 * se


def test_auc_with_ties(spark):
    rows = [(1, 1, 3.0), (0, 1, 3.0), (1, 0, 2.0), (0, 0, 1.0), (0, 0, 3.0), (1, 1, 5.0)]
    r = M.classification_metrics(spark.createDataFrame([("c", *x) for x in rows], "c string, y int, prediction int, score double"), ["c"]).first()
    wins = [(p[2] > q[2]) + 0.5 * (p[2] == q[2]) for p in rows if p[0] for q in rows if not q[0]]
    assert r.n == 6 and abs(r.auc - np.mean(wins)) < 1e-12 and abs(r.precision - 2 / 3) < 1e-12


def test_horizons_and_sets(spark):
    rng = np.random.default_rng(6)
    v = np.cumsum(rng.normal(size=160))
    df = spark.createDataFrame([("c", i, float(a), float(rng.normal())) for i, a in enumerate(v)], "cell string, t int, level double, z double")
    got = {r.horizon: r for r in M.horizon_sweep(df, ["level"], ["level", "z"], "level", (1, 20), "t", [0.01], ["cell"]).collect()}
    assert set(got) == {1, 20} and all(abs(r.delta - (r.r2 - r.base_r2)) < 1e-12 for r in got.values())
    ahead = M.nested_linear_cv(df.withColumn("y", F.lead("level", 20).over(M.W.partitionBy("cell").orderBy("t"))), ["level"], "y", "t", [0.01], keys=["cell"])
    assert abs(got[20].base_r2 - ahead.agg(F.avg("r2")).first()[0]) < 1e-9


# graphs


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")


def test_long_paths_count(spark):
    names = [f"n{i:02d}" for i in range(40)]
    got = {r.node: r.betweenness for r in G.betweenness(graph(spark, zip(names, names[1:])), sources=40).collect()}
    assert all(abs(got[n] - 2 * i * (39 - i) / (39 * 38)) < 1e-9 for i, n in enumerate(names))


def test_pagerank_tells_when_it_has_not_settled(spark):
    with pytest.raises(RuntimeError, match="converge"):
        G.pagerank(graph(spark, [("a", "b"), ("b", "c"), ("c", "d")]), rounds=5, tolerance=0.0)


def best_modularity(pairs):
    nodes = sorted({x for p in pairs for x in p})
    best = -1.0
    for labels in itertools.product(range(len(nodes)), repeat=len(nodes)):
        if labels[0] or any(x > max(labels[:i], default=-1) + 1 for i, x in enumerate(labels)):
            continue
        of = dict(zip(nodes, labels))
        degree = {c: sum((of[a] == c) + (of[b] == c) for a, b in pairs) for c in labels}
        best = max(best, sum(sum(of[a] == of[b] == c for a, b in pairs) / len(pairs) - (degree[c] / 2 / len(pairs)) ** 2 for c in set(labels)))
    return best


@pytest.mark.parametrize("pairs", [["ab", "ac", "bc", "cd", "de", "df", "ef"], ["ab", "bc", "cd", "de", "ea"], ["ab", "ac", "ad", "bc", "bd", "cd", "de", "ef", "fg", "eg"]])
def test_communities_are_near_the_best_partition(spark, pairs):
    e = graph(spark, [tuple(p) for p in pairs])
    assert G.modularity(e, G.communities(e)).first().modularity >= best_modularity([tuple(p) for p in pairs]) - 0.03


def test_triangles_by_brute_force(spark):
    rng = random.Random(3)
    pairs = {(w, *sorted(rng.sample("abcdefgh", 2))) for w in range(4) for _ in range(14)}
    e = spark.createDataFrame(sorted(pairs), "w int, src string, dst string")
    want = {w: sum((w, a, b) in pairs and (w, b, c) in pairs and (w, a, c) in pairs for a, b, c in itertools.combinations("abcdefgh", 3)) for w in range(4)}
    assert {r.w: r.triangles for r in G.triangles(e, ["w"]).collect()} == want


def test_novelty_by_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, rng.randrange(20), " ".join(words)))
    rows += [(160, 3, None), (161, 4, None), (162, 3, ""), (163, 4, "")]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}

    sets = {i: None if t is None else grams(t) for i, _, t in rows}
    got = {r.msg_id: r for r in G.text_novelty(spark.createDataFrame(rows, "msg_id int, day int, text string"), "day", 7, 0.5).collect()}
    assert len(got) == len(rows)
    for i, day, _ in rows:
        s = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j, d, _ in rows if 1 <= day - d <= 7 and sets[i] is not None and sets[j] is not None), default=0.0)
        assert got[i].status == ("reprint" if s >= 0.95 else "update" if s >= 0.5 else "new") and abs(got[i].likeness - (s if s >= 0.5 else 0.0)) < 1e-12


def test_entity_ids_are_dense_and_ordered(spark):
    values = ["b"] * 5 + ["a"] * 5 + [f"s{i:03d}" for i in range(300)] + ["c"] * 9
    df = spark.createDataFrame([(v,) for v in values], "e string")
    got = [r.e for r in D.entity_index(df, "e").orderBy("id").collect()]
    assert got == ["c", "a", "b", *(f"s{i:03d}" for i in range(300))]
    assert [r.id for r in D.entity_index(df, "e", "value").orderBy("e").collect()] == list(range(303))


def test_a_text_that_fails_spares_its_batch(spark):
    def load():
        def score(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [float(len(t)) for t in texts]

        return score

    df = spark.createDataFrame([("aa",), ("bad",), ("cccc",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(hooks.text_scorer(load)("t")).collect()] == [2.0, 0.0, 4.0, 0.0]
