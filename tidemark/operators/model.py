"""Walk-forward comparison of models: splits, folds, scaling, fits from Gram matrices, metrics, ablations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import trees as T
from tidemark.operators.stats import fdr_bh, gram, unpack
from tidemark.scratch import materialize


def numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """_rn from 1 in time order and _n, by key."""
    return df.withColumns({"_rn": F.row_number().over(W.partitionBy(*keys).orderBy(order)), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})


def time_split(df: DataFrame, share: float, keys: Sequence[str], order: str) -> DataFrame:
    """split: train for the first ``share`` of each key's rows, else test."""
    out = numbered(df, keys, order)
    return out.withColumn("split", F.when(F.col("_rn") <= F.floor(share * F.col("_n")), "train").otherwise("test")).drop("_rn", "_n")


def walk_forward(df: DataFrame, k: int, keys: Sequence[str], order: str, gap: int = 0) -> DataFrame:
    """fold 1 to k and role: test blocks are the last k of n // (k + 1) rows; train is all before, less ``gap`` rows."""
    out = numbered(df, keys, order).withColumn("_size", F.floor(F.col("_n") / (k + 1))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    begin = F.col("_n") - (k + 1 - F.col("fold")) * F.col("_size")
    role = F.when(F.col("_rn") <= begin - gap, "train").when((F.col("_rn") > begin) & (F.col("_rn") <= begin + F.col("_size")), "test")
    return out.withColumn("role", role).where("role IS NOT NULL").drop("_rn", "_n", "_size")


def inner_tail(df: DataFrame, share: float, keys: Sequence[str], order: str) -> DataFrame:
    """part: fit for the first ``share`` of each fold's rows, else validate."""
    return time_split(df, share, keys, order).withColumn("part", F.when(F.col("split") == "train", "fit").otherwise("validate")).drop("split")


def purged(df: DataFrame, label_at: str, fit_at: str) -> DataFrame:
    """Train rows whose label was known when the model was fitted; all test rows."""
    return df.where((F.col("role") == "test") | (F.col(label_at) <= F.col(fit_at)))


def fold_scale(df: DataFrame, columns: Sequence[str], folds: Sequence[str]) -> DataFrame:
    """Columns standardised with mean and population deviation of each fold's train rows; constant ones are centred only."""
    train = F.col("role") == "train"
    stats = df.groupBy(*folds).agg(*[x for c in columns for x in (F.avg(F.when(train, F.col(c))).alias(f"_m_{c}"), F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}"))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.join(stats, list(folds)).withColumns(scaled).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown features: {missing}")


def coordinate_descent(g: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1: float, start: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """Minimiser of (1 / 2n) |y - Xb|^2 + alpha (l1 |b|_1 + (1 - l1) / 2 |b|^2) from X'X and X'y. Without an l1 part it is
    solved directly (the shortest of several solutions); with one, raises if ``rounds`` rounds do not settle it."""
    if alpha * l1 == 0:
        return np.linalg.lstsq(g + n * alpha * np.eye(len(xy)), xy, rcond=None)[0]
    b = start.copy()
    for _ in range(rounds):
        old = b.copy()
        for j in range(len(b)):
            if g[j, j] <= 0:
                continue
            rho = (xy[j] - g[j] @ b + g[j, j] * b[j]) / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (g[j, j] / n + alpha * (1 - l1))
        if np.abs(b - old).max(initial=0) < 1e-10 * max(1.0, np.abs(b).max(initial=0)):
            return b
    raise RuntimeError(f"coordinate descent did not converge in {rounds} rounds")


def standardised(m: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """From products of (y, 1, features): n, means, y's mean, deviations, and X'X and X'y of centred and scaled features."""
    n = m[1, 1]
    mean, my = m[1, 2:] / n, m[0, 1] / n
    sd = np.sqrt(np.maximum(np.diag(m)[2:] / n - mean**2, 0))
    sd = np.where(sd > 1e-12, sd, 1)
    g = (m[2:, 2:] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    return n, mean, my, sd, g, (m[0, 2:] - n * my * mean) / sd


def penalised_fit(m: np.ndarray, path: Sequence[float], l1: float) -> list[np.ndarray]:
    """Intercept and slopes for each penalty of a falling ``path``, each started from the one before."""
    n, mean, my, sd, g, xy = standardised(m)
    b, out = np.zeros(len(mean)), []
    for a in path:
        b = coordinate_descent(g, xy, n, a, l1, b)
        out.append(np.concatenate([[my - (b / sd) @ mean], b / sd]))
    return out


def fold_bounds(n, outer: int, inner: int, div) -> list:
    """Last rows of the train and validation parts of all folds of ``n`` rows; for numbers and for columns."""
    out = []
    for fold in range(1, outer + 1):
        begin = n - div(n, outer + 1) * (outer + 1 - fold)
        out += [begin - div(begin, inner + 1) * j for j in range(inner + 1)]
    return out


def nested_linear_cv(df: DataFrame, features: Sequence[str], y: str, order: str, alphas: Sequence[float], outer: int = 5, inner: int = 3, l1: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Penalised regression of each cell with its penalty chosen by inner walk-forward folds: keys, fold, alpha, intercept, betas.

    Products are summed by blocks of time in one Spark aggregate. Blocks are cut at the bounds of the folds, outer ones
    and inner ones (each of n // (k + 1) rows, as in ``walk_forward``), so every fold's matrix is a sum of those of its
    blocks, rows are read once and only small matrices are solved. Features are standardised within each fit.
    """
    _require(df, features)
    cols = ["_y", "_one", *features]
    k = len(cols)
    d = numbered(df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *features])), keys, order).withColumns({"_y": F.col(y).cast("double"), "_one": F.lit(1.0)})
    block = F.lit(0)
    for bound in fold_bounds(F.col("_n"), outer, inner, lambda a, b: F.floor(a / b)):
        block = block + (F.col("_rn") > bound).cast("int")
    d = d.withColumn("_block", block)
    blocks = gram(d, [*keys, "_block"], cols)
    grid = sorted(alphas, reverse=True)

    def mse(m: np.ndarray, c: np.ndarray) -> float:
        v = np.concatenate([[1.0], -c])
        return float(v @ m @ v) / max(m[1, 1], 1)

    def fit(m: np.ndarray, path: Sequence[float]) -> list[np.ndarray]:
        return penalised_fit(m, path, l1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = {r["_block"]: unpack(r.g, k) for _, r in pdf.iterrows()}
        cell = pdf.iloc[0][list(keys)].tolist()
        n = int(sum(x[1, 1] for x in m.values()))
        bounds, rows = fold_bounds(n, outer, inner, lambda a, b: a // b), []

        def total(lo: int, hi: int) -> np.ndarray:
            """Products of the rows after the lo-th up to the hi-th; both are bounds, 0 or n."""
            first, last = sum(b <= lo for b in bounds) if lo else 0, sum(b < hi for b in bounds)
            return sum((x for i, x in m.items() if first <= i <= last), np.zeros((k, k)))

        size = n // (outer + 1)
        for fold in range(1, outer + 1):
            begin = n - (outer + 1 - fold) * size
            step = begin // (inner + 1)
            errors = np.zeros(len(grid))
            for j in range(1, inner + 1):
                cut = begin - (inner + 1 - j) * step
                held = total(cut, cut + step)
                errors += [mse(held, c) for c in fit(total(0, cut), grid)]
            best = int(np.argmin(errors))
            c = fit(total(0, begin), grid[: best + 1])[-1]
            test = total(begin, begin + size)
            tss = test[0, 0] - test[0, 1] ** 2 / max(test[1, 1], 1)
            rows.append((*cell, fold, grid[best], float(c[0]), c[1:].tolist(), mse(test, c), float(1 - mse(test, c) * test[1, 1] / tss) if tss > 0 else None, int(test[1, 1])))
        return pd.DataFrame(rows, columns=[*keys, "fold", "alpha", "intercept", "betas", "mse", "r2", "n_test"])

    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    return blocks.groupBy(*keys).applyInPandas(run, types + "fold int, alpha double, intercept double, betas array<double>, mse double, r2 double, n_test long")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    _require(df, features)
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


@dataclass(frozen=True)
class Regressor:
    """Settings of one kind of model; fits are made for all cells at once."""

    kind: str
    y: str
    seed: int
    settings: dict

    def trees(self, train: DataFrame, features: Sequence[str], by: Sequence[str]) -> T.Trees:
        s = self.settings
        if self.kind == "forest":
            return T.fit_trees(train, by, features, self.y, s.get("trees", 20), s.get("depth", 5), least=s.get("least", 1), seed=self.seed)
        return T.fit_trees(train, by, features, self.y, s.get("trees", 10), s.get("depth", 3), least=s.get("least", 1), rate=s.get("rate", 0.1), seed=self.seed)

    def coefficients(self, train: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
        """by, intercept, betas: products of each cell's rows in one aggregate, a small system for each cell."""
        l1 = {"linear": 0.0, "lasso": 1.0, "ridge": 0.0, "elastic": self.settings.get("l1", 0.5)}[self.kind]
        alpha = 0.0 if self.kind == "linear" else self.settings.get("alpha", 0.01)
        k, by = len(features) + 2, list(by)
        cols = ["_y", "_one", *features]
        rows = train.withColumns({"_y": F.col(self.y).cast("double"), "_one": F.lit(1.0), **{c: F.col(c).cast("double") for c in features}})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            r = pdf.iloc[0]
            c = penalised_fit(unpack(r.g, k), [alpha], l1)[0]
            return pd.DataFrame([(*r[by].tolist(), float(c[0]), c[1:].tolist())], columns=[*by, "intercept", "betas"])

        types = "".join(f"`{c}` {train.schema[c].dataType.simpleString()}, " for c in by)
        return gram(rows, by, cols).groupBy(*by).applyInPandas(run, types + "intercept double, betas array<double>")


def regressor(kind: str, y: str, seed: int = 7, **settings) -> Regressor:
    """linear, lasso, ridge, elastic, forest or boosting. Penalties follow (1 / 2n) |y - Xb|^2 + alpha (...); see README."""
    return Regressor(kind, y, seed, settings)


def fit_predict(df: DataFrame, features: Sequence[str], y: str, kind: str, keys: Sequence[str] = (), **settings) -> DataFrame:
    """Predictions on each fold's test rows: all columns, fold, prediction. All cells and folds are fitted together: linear
    models from one aggregate of products, trees from one histogram a level. Features are standardised within each fit
    of a linear model. Rows with a null feature or y are left out of fits, those with a null feature of predictions."""
    _require(df, features)
    by, model = [*keys, "fold"], regressor(kind, y, **settings)
    df = materialize(df, "folds")
    train, test = df.where("role = 'train'"), df.where("role = 'test'")
    if kind in ("forest", "boosting"):
        return T.predict_trees(test, model.trees(train, features, by))
    fitted = test.join(model.coefficients(train, features, by), by)
    x = F.array(*[F.col(c).cast("double") for c in features])
    value = F.col("intercept") + F.aggregate(F.zip_with("betas", x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    return fitted.withColumn("prediction", value).where("prediction IS NOT NULL").drop("intercept", "betas")


def fit_spike_classifier(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = (), seed: int = 7, trees: int = 20, depth: int = 5) -> DataFrame:
    """Random forest with balanced weights n / (2 n_c), one for each cell and fold: keys, fold, y, score and prediction of test
    rows. A node tries about the root of the number of features; a fold whose train rows have one class gives that."""
    _require(df, features)
    by = [*keys, "fold"]
    df = materialize(df, "folds")
    train = df.where("role = 'train'")
    counts = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.coalesce(F.sum(F.col(y).cast("int")), F.lit(0)).alias("_pos"))
    share = F.when(F.col(y) == 1, F.col("_pos")).otherwise(F.col("_all") - F.col("_pos"))
    weighted = train.join(counts, by).withColumn("_weight", F.col("_all") / (2.0 * F.greatest(share, F.lit(1)))).drop("_all", "_pos")
    fit = T.fit_trees(weighted, by, features, y, trees, depth, share=len(features) ** -0.5, weight="_weight", seed=seed)
    found = T.predict_trees(df.where("role = 'test'"), fit, "score")
    return found.select(*by, F.col(y).cast("int").alias("y"), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


def regression_metrics(preds: DataFrame, keys: Sequence[str], y: str = "y", p: str = "prediction") -> DataFrame:
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
    )


def over_folds(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return metrics.groupBy(*keys).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def classification_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """precision, recall, f1 and auc (Mann-Whitney by average ranks; 0.5 with one class) of y, prediction, score."""
    y, p = F.col("y") == 1, F.col("prediction") == 1
    scores = preds.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_k"), F.count_if(y).alias("_y"), F.count_if(y & p).alias("_yp"), F.count_if(p).alias("_q"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    agg = scores.withColumn("_r", before + (F.col("_k") + 1) / 2).groupBy(*keys).agg(
        F.sum("_k").alias("n"), F.sum("_y").alias("_n1"), F.sum("_yp").alias("_tp"), F.sum("_q").alias("_p"), F.sum(F.col("_y") * F.col("_r")).alias("_sum")
    )
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n1, n0 = F.col("_n1"), F.col("n") - F.col("_n1")
    return agg.select(
        *keys, "n", over(F.col("_tp"), F.col("_p")).alias("precision"), over(F.col("_tp"), n1).alias("recall"), over(2 * F.col("_tp"), F.col("_p") + n1).alias("f1"),
        F.coalesce((F.col("_sum") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0)), F.lit(0.5)).alias("auc"),
    )


def directional_accuracy(preds: DataFrame, keys: Sequence[str], y: str = "y", p: str = "prediction") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(((F.col(y) > 0) == (F.col(p) > 0)).cast("double")).alias("accuracy"))


def univariate_fit(df: DataFrame, features: Sequence[str], y: str, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """Ridge slope of each cell's single features, and R2 on train and test, from aggregates: keys, feature, slope, train_r2, test_r2."""
    long = df.select(*keys, "split", F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_x")) for c in features])).alias("z")).select(*keys, "split", "_y", "z.*")
    s = long.groupBy(*keys, "feature", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("c"))
    w = s.groupBy(*keys, "feature").pivot("split", ["train", "test"]).agg(*[F.first(c).alias(c) for c in ("n", "mx", "my", "vx", "vy", "c")])
    b = F.col("train_c") / (F.col("train_vx") + alpha / F.col("train_n"))

    def r2(part: str) -> Column:
        shift = F.col(f"{part}_my") - F.col("train_my") - F.col("slope") * (F.col(f"{part}_mx") - F.col("train_mx"))
        mse = F.col(f"{part}_vy") - 2 * F.col("slope") * F.col(f"{part}_c") + F.col("slope") * F.col("slope") * F.col(f"{part}_vx") + shift * shift
        return 1 - mse / F.nullif(F.col(f"{part}_vy"), F.lit(0.0))

    return w.withColumn("slope", b).select(*keys, "feature", "slope", r2("train").alias("train_r2"), r2("test").alias("test_r2"))


def ranked_features(cells: DataFrame, key: str = "target", level: float = 0.05) -> DataFrame:
    """Screened features of each target by |r|: key, feature, n, r, p, q (Benjamini-Hochberg within the target), significant
    (q at most ``level``) and rank."""
    scored = fdr_bh(cells, [key], "p", ["feature"]).withColumn("significant", F.col("q") <= level)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("r")), "feature")))


def feature_sets(ranked: DataFrame, sizes: Sequence[int], key: str = "target") -> DataFrame:
    """Top features of each target by |r|: key, size, features (in order)."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("r")), "feature"))
    top = ranked.withColumn("_i", r).where(F.col("_i") <= max(sizes)).withColumn("size", F.explode(F.lit(list(sizes)).cast("array<int>"))).where("_i <= size")
    return top.groupBy(key, "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "feature"))), lambda x: x["feature"]), ",").alias("features"))


def top_coefficients(fit: T.Trees) -> DataFrame:
    """Importances of every cell's features: by, feature, value, greatest first."""
    return T.importances(fit).orderBy(*fit.by, F.desc("value"), "feature")


def ablation(df: DataFrame, sets: dict[str, Sequence[str]], kinds: Sequence[str], y: str, folds: int, order: str, keys: Sequence[str] = (), **settings) -> DataFrame:
    """Metrics of every cell, feature set and model on the same rows: those where all features of all sets are there."""
    every = sorted({c for cs in sets.values() for c in cs})
    _require(df, every)
    rows = walk_forward(df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *every])), folds, keys, order)
    out = None
    for name, cs in sets.items():
        for kind in kinds:
            m = regression_metrics(fit_predict(rows, cs, y, kind, keys, **settings), [*keys, "fold"], y).withColumns({"features": F.lit(name), "model": F.lit(kind)})
            out = m if out is None else out.unionByName(m)
    return out


def linear_ablation(
    df: DataFrame, sets: dict[str, Sequence[str]], y: str, order: str, alphas: Sequence[float], outer: int = 5, keys: Sequence[str] = (), models: dict[str, float] | None = None,
) -> DataFrame:
    """Nested penalised fits of every cell and feature set on the same rows, those where all features of all sets are there:
    keys, fold, features, model, alpha, mse, r2, n_test. ``models`` maps names to the share of the l1 penalty."""
    every = sorted({c for cs in sets.values() for c in cs})
    _require(df, every)
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *every]))
    out = None
    for name, cs in sets.items():
        for model, l1 in (models or {"ridge": 0.0, "lasso": 1.0}).items():
            m = nested_linear_cv(rows, cs, y, order, alphas, outer, l1=l1, keys=keys).withColumns({"features": F.lit(name), "model": F.lit(model)})
            out = m if out is None else out.unionByName(m)
    return out


def horizon_sweep(df: DataFrame, base: Sequence[str], features: Sequence[str], level: str, horizons: Sequence[int], order: str, alphas: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Fits of ``level`` so many rows ahead, with ``features`` and with the ``base`` ones alone: keys, horizon, base_r2, r2,
    delta (means over folds). The horizon is exploded into rows, so all of them are fitted in two jobs."""
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(level, h).over(W.partitionBy(*keys).orderBy(order)).alias("_ahead")) for h in horizons])
    rows = materialize(df.withColumn("_h", ahead).select("*", F.inline("_h")).drop("_h"), "horizons")
    fit = lambda cs, name: linear_ablation(rows, {name: cs, "all": features}, "_ahead", order, alphas, keys=[*keys, "horizon"], models={"lasso": 1.0})
    mean = fit(list(base), "base").groupBy(*keys, "horizon").pivot("features", ["base", "all"]).agg(F.avg("r2"))
    return mean.select(*keys, "horizon", F.col("base").alias("base_r2"), F.col("all").alias("r2"), (F.col("all") - F.col("base")).alias("delta"))


def lift(metrics: DataFrame, base: str) -> DataFrame:
    """Gain in R2 and percent cut in MSE of each feature set over ``base``, by model."""
    b = metrics.where(F.col("features") == base).select("model", F.col("r2").alias("_r2"), F.col("mse").alias("_mse"))
    return metrics.join(b, "model").select("features", "model", (F.col("r2") - F.col("_r2")).alias("r2_gain"), (100 * (F.col("_mse") - F.col("mse")) / F.col("_mse")).alias("mse_cut"))


def leaderboard(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("r2"), "features", "model").limit(k)


def pca_project(df: DataFrame, column: str, k: int, fit: Column) -> DataFrame:
    """Array ``projected`` of ``k`` components, fitted on the rows of ``fit`` and centred by their means; each component's
    sign is such that its largest loading is positive."""
    vectors = df.withColumn("_v", F.transform(column, lambda x: x.cast("double")))
    means = vectors.where(fit).select(F.posexplode("_v").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m"))
    mean = F.lit([r["m"] for r in means.orderBy("d").collect()])  # as many numbers as dimensions
    centred = vectors.withColumn("_c", array_to_vector(F.zip_with("_v", mean, lambda a, b: a - b)))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred.where(fit))
    loads = model.pc.toArray()
    signs = F.lit([float(np.sign(loads[np.abs(loads[:, j]).argmax(), j]) or 1.0) for j in range(k)])
    out = model.transform(centred).withColumn("projected", F.zip_with(vector_to_array("_p"), signs, lambda a, b: a * b))
    return out.drop("_v", "_c", "_p")


def block_bootstrap(errors: DataFrame, a: str, b: str, order: str, block: int, replicates: int, seed: int = 7) -> DataFrame:
    """Interval of the mean difference of paired errors: temporal blocks are drawn with Poisson weights by hash, for all
    replicates in one aggregate. mean, lo (2.5 %), hi (97.5 %)."""
    d = errors.select(F.floor(F.col(order) / block).alias("_b"), (F.col(a) - F.col(b)).alias("_d")).groupBy("_b").agg(F.sum("_d").alias("_s"), F.count("_d").alias("_n"))
    u = F.pmod(F.xxhash64("_b", "_r", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight, total, p = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(8):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k + 1
    reps = d.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = reps.groupBy("_r").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("m"))
    found = d.agg((F.sum("_s") / F.sum("_n")).alias("mean"))
    return found.crossJoin(means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")))  # one row each
