"""Association statistics of all cells at once.

A long table holds one row per observation: cell keys, order, x, y. Statistics are grouped aggregates over it; only
k x k systems, one small row for each cell, are solved in Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.dist import chi2_pvalue, f_pvalue, t_pvalue, t_two_sided
from tidemark.operators.ranges import LEAST, average_ranks, beside, bounded, running, split_long
from tidemark.operators.series import corr
from tidemark.scratch import materialize


def complete(long: DataFrame) -> DataFrame:
    return long.where("x IS NOT NULL AND y IS NOT NULL")


def _corr_p(df: DataFrame, least: int) -> DataFrame:
    """Neutral result (r 0, p 1) for cells of fewer than ``least`` rows or without variation."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    ok = (F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r")
    p = F.when(F.abs("r") >= 1, 0.0).otherwise(F.coalesce(t_pvalue(t, F.col("n") - 2), F.lit(1.0)))
    return df.withColumn("p", F.when(ok, p).otherwise(1.0)).withColumn("r", F.when(ok, F.col("r")).otherwise(0.0))


def pearson_cells(long: DataFrame, keys: Sequence[str], least: int = 30) -> DataFrame:
    return _corr_p(complete(long).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), corr("x", "y").alias("r")), least)


def average_rank(c: str, keys: Sequence[str]) -> Column:
    first = F.rank().over(W.partitionBy(*keys).orderBy(c))
    return first + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2


def spearman_cells(long: DataFrame, keys: Sequence[str], least: int = 30, most: int = LEAST) -> DataFrame:
    """Correlation of average ranks. Cells of more than ``most`` rows are ranked by counts of their values, cut into pieces."""
    rest, big = split_long(complete(long).select(*keys, "x", "y"), keys, most)
    ranked = rest.select(*keys, average_rank("x", keys).alias("x"), average_rank("y", keys).alias("y"))
    if big is not None:
        ranked = ranked.unionByName(average_ranks(big, keys, ["x", "y"], most))
    return pearson_cells(ranked, keys, least)


def inversions(ranked: DataFrame, keys: Sequence[str], most: int = LEAST) -> DataFrame:
    """Pairs with x rising and the whole number _q (0 or more) falling, as _d by cell, counted bit by bit of _q: two numbers are
    ordered by the first bit in which they differ, so each bit up to the cell's largest _q needs one running sum. Rows that
    share x and the bits are one row before it, and long sums are taken in pieces."""
    by = [*keys, "_l", "_p"]
    top = ranked.groupBy(*keys).agg((F.length(F.bin(F.max("_q"))) - 1).alias("_top"))
    level = ranked.join(top, list(keys)).withColumn("_l", F.explode(F.sequence(F.lit(0), "_top")))
    coded = level.withColumns({"_p": F.expr("shiftright(_q, _l + 1)"), "_b": F.expr("shiftright(_q, _l) & 1")})
    cells = coded.groupBy(*by, "x").agg(F.sum("_b").alias("_ones"), F.sum(1 - F.col("_b")).alias("_zeros"))
    summed = running(materialize(cells, "levels"), by, "x", {"_before": "_ones"}, least=most)
    return summed.groupBy(*keys).agg(F.sum(F.col("_before") * F.col("_zeros")).alias("_d"))


def kendall_cells(long: DataFrame, keys: Sequence[str], most: int = LEAST) -> DataFrame:
    """tau-b. Discordant pairs are inversions of y's rank in x's order; no pairs are formed."""
    d = complete(long)
    n0 = lambda k: k * (k - 1) / 2
    tie = lambda cols, name: d.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(F.sum(n0(F.col("_k"))).alias(name))
    values = d.select(*keys, "y").distinct().withColumn("_one", F.lit(1))
    ranks = materialize(running(materialize(values, "values"), keys, "y", {"_q": "_one"}, least=most).drop("_one"), "ranks")
    inv = inversions(d.join(ranks, [*keys, "y"]).select(*keys, "x", "_q"), keys, most)
    base = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = base.join(tie(["x"], "_n1"), list(keys)).join(tie(["y"], "_n2"), list(keys)).join(tie(["x", "y"], "_n3"), list(keys)).join(inv, list(keys))
    pairs = n0(F.col("n"))
    concordant = pairs - F.col("_n1") - F.col("_n2") + F.col("_n3") - F.col("_d")
    return out.select(*keys, "n", ((concordant - F.col("_d")) / F.sqrt((pairs - F.col("_n1")) * (pairs - F.col("_n2")))).alias("tau"))


def without_each_source(long: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """(keys, source, share, dominant, n, r, slope): x and y of each cell without one of its sources, for every source at once.

    Moments are summed by cell and source in one pass; those of the others are the cell's less the source's, by the rule
    that puts two groups' moments together, so leaving each source out costs no further pass. r and slope are null where
    nothing varies without the source; ``dominant`` marks the source of most rows (of ties the least).
    """
    d = complete(long)
    parts = materialize(d.groupBy(*keys, source).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), (F.var_pop("x") * F.count(F.lit(1))).alias("_xx"), (F.var_pop("y") * F.count(F.lit(1))).alias("_yy"), (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("_xy")
    ), "moments")
    n = F.sum("_n")
    means = parts.groupBy(*keys).agg(n.alias("N"), *[(F.sum(F.col("_n") * F.col(f"_m{c}")) / n).alias(f"M{c.upper()}") for c in "xy"])
    off = lambda c: F.col(f"_m{c}") - F.col(f"M{c.upper()}")
    sums = [F.sum(F.col(f"_{a}{b}") + F.col("_n") * off(a) * off(b)).alias(f"{a}{b}".upper()) for a, b in ("xx", "yy", "xy")]
    whole = parts.join(means, list(keys)).groupBy(*keys, "N", "MX", "MY").agg(*sums, F.max("_n").alias("_most"))
    least = parts.join(whole.select(*keys, "_most"), list(keys)).where("_n = _most").groupBy(*keys).agg(F.min(source).alias("_top"))
    both = parts.join(whole, list(keys)).join(least, list(keys))
    rest = F.col("N") - F.col("_n")
    away = lambda c: off(c) * F.col("N") / F.nullif(rest, F.lit(0))
    left = {f"_r{a}{b}": F.col(f"{a}{b}".upper()) - F.col(f"_{a}{b}") - away(a) * away(b) * F.col("_n") * rest / F.col("N") for a, b in ("xx", "yy", "xy")}
    noise = lambda c: F.col(f"_r{c}") > 1e-12 * F.col(c.upper())
    both = both.withColumns(left).withColumns({"_okx": noise("xx"), "_oky": noise("yy")})
    return both.select(
        *keys, source, (F.col("_n") / F.col("N")).alias("share"), (F.col(source) == F.col("_top")).alias("dominant"), rest.alias("n"),
        F.when(F.col("_okx") & F.col("_oky"), F.col("_rxy") / F.sqrt(F.col("_rxx") * F.col("_ryy"))).alias("r"), F.when(F.col("_okx"), F.col("_rxy") / F.col("_rxx")).alias("slope"),
    )


def ols_cells(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return complete(long).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")
    )


def residuals(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = complete(long)
    return d.join(ols_cells(d, keys), list(keys)).withColumn("u", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))


def hac_cells(long: DataFrame, keys: Sequence[str], order: str, lags: int = 10, corrected: bool = True, most: int = LEAST) -> DataFrame:
    """Slope with Newey-West standard error (Bartlett weights) and t test. All lags come from one window pass, in which cells of
    more than ``most`` rows are cut into pieces."""
    u = residuals(long, keys)
    z0, z1 = F.col("u"), F.col("u") * F.col("x")
    rows = u.select(*keys, order, "x", "n", "slope", z0.alias("_z0"), z1.alias("_z1"))
    past = lambda d, by: d.withColumns({f"_{k}_{j}": F.lag(f"_z{k}", j).over(W.partitionBy(*by).orderBy(order)) for k in (0, 1) for j in range(1, lags + 1)})
    rows = bounded(rows, keys, order, lags, 0, past, most)

    def s(a: int, b: int) -> Column:
        total = F.sum(F.col(f"_z{a}") * F.col(f"_z{b}"))
        for j in range(1, lags + 1):
            weight = 1 - j / (lags + 1)
            cross = F.coalesce(F.sum(F.col(f"_z{a}") * F.col(f"_{b}_{j}")), F.lit(0.0)) + F.coalesce(F.sum(F.col(f"_{a}_{j}") * F.col(f"_z{b}")), F.lit(0.0))
            total = total + weight * cross
        return total

    agg = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("slope").alias("slope"), F.sum("x").alias("_sx"), F.sum(F.col("x") * F.col("x")).alias("_sxx"), s(0, 0).alias("_s00"), s(0, 1).alias("_s01"), s(1, 1).alias("_s11")
    )
    det = F.col("n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    # last row of the inverse of X'X is (-sx, n) / det
    var = (F.col("_sx") * F.col("_sx") * F.col("_s00") - 2 * F.col("n") * F.col("_sx") * F.col("_s01") + F.col("n") * F.col("n") * F.col("_s11")) / (det * det)
    var = var * (F.col("n") / (F.col("n") - 2)) if corrected else var
    out = agg.select(*keys, "n", "slope", F.sqrt(var).alias("se")).withColumn("t", F.col("slope") / F.col("se"))
    return out.withColumn("p", t_pvalue("t", F.col("n") - 2))


def fdr_bh(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg q of each row within its family."""
    order = [F.col(p), *map(F.col, tie)]
    m = F.count(p).over(W.partitionBy(*family))
    raw = F.col(p) * m / F.row_number().over(W.partitionBy(*family).orderBy(*order))
    back = W.partitionBy(*family).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    ranked = df.withColumns({"_raw": raw, "_i": F.row_number().over(W.partitionBy(*family).orderBy(*order))})
    return ranked.withColumn("q", F.least(F.min("_raw").over(back), F.lit(1.0))).drop("_raw", "_i")


def breusch_pagan(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    u = residuals(long, keys)
    out = u.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_r2(F.col("u") * F.col("u"), F.col("x")).alias("_r2")).withColumn("lm", F.col("n") * F.col("_r2")).drop("_r2")
    return out.withColumn("p", chi2_pvalue("lm", 1))


def effect_size(df: DataFrame, r: str = "r") -> DataFrame:
    x = F.col(r)
    return df.withColumns({"r2": x * x, "cohens_d": 2 * x / F.nullif(F.sqrt(1 - x * x), F.lit(0.0))})


def segment_correlations(df: DataFrame, segments: dict[str, Column], least: int = 30) -> DataFrame:
    """Correlation in each of several, possibly overlapping segments: a row goes into an array of its tags."""
    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]), lambda t: t.isNotNull())
    long = complete(df).select(F.explode(tags).alias("segment"), "x", "y")
    return long.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), corr("x", "y").alias("r")).where(F.col("n") >= least)


def stability(long: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """Train and test correlation of each cell, how much of it is lost, whether the sign flips, and whether it is robust."""
    cells = pearson_cells(long, [*keys, split])
    wide = cells.groupBy(*keys).pivot(split, ["train", "test"]).agg(F.first("r").alias("r"), F.first("p").alias("p"), F.first("n").alias("n"))
    lost = (F.abs("train_r") - F.abs("test_r")) / F.nullif(F.abs("train_r"), F.lit(0.0))
    wide = wide.withColumns({"degradation": lost, "flips": F.signum("train_r") * F.signum("test_r") < 0})
    return wide.withColumn("robust", (F.abs("test_r") > 0.05) & (F.col("test_p") < 0.05) & (F.col("degradation") < 0.5) & ~F.col("flips"))


def distribution_shift(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """Mean and deviation of test against train, in percent of train."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("z")).select(split, "z.*")
    wide = long.groupBy("metric").pivot(split, ["train", "test"]).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    pct = lambda a, b: 100 * (F.col(b) - F.col(a)) / F.nullif(F.abs(F.col(a)), F.lit(0.0))
    return wide.select("metric", pct("train_m", "test_m").alias("mean_shift"), pct("train_s", "test_s").alias("std_shift"))


def linearity_check(long: DataFrame, keys: Sequence[str], least: float = 0.1) -> DataFrame:
    """Relative gap between Spearman and Pearson; below ``least`` the relation counts as linear."""
    a = pearson_cells(long, keys).select(*keys, "n", F.col("r").alias("pearson"))
    b = spearman_cells(long, keys).select(*keys, F.col("r").alias("spearman"))
    gap = F.abs(F.col("spearman") - F.col("pearson")) / F.nullif(F.abs("pearson"), F.lit(0.0))
    return a.join(b, list(keys)).withColumn("gap", gap).withColumn("linear", F.coalesce(F.col("gap") < least, F.lit(False)))


def regime_share(df: DataFrame, c: str, split: str, p: float = 0.75) -> DataFrame:
    """Share of train and test rows above the train quantile."""
    q = df.where(F.col(split) == "train").agg(F.percentile(c, p).alias("_q"))
    return df.join(F.broadcast(q)).groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(c) > F.col("_q")).cast("double")).alias("share"))


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: Column | None = None, *besides: Column) -> DataFrame:
    """For each cell the sums of products of all pairs of columns, and n: one aggregate, however long the series. With
    ``rows``, the sums are over the rows for which it holds, and ``besides`` are aggregates over all rows of the cell."""
    cols = list(columns)
    if rows is None:
        df, rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)), F.lit(True)
    sums = [F.coalesce(F.sum(F.when(rows, F.col(a) * F.col(b))), F.lit(0.0)) for i, a in enumerate(cols) for b in cols[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"), *besides)


def gram_sets(df: DataFrame, keys: Sequence[str], sets: dict[int, Sequence[str]], label: str) -> DataFrame:
    """``gram`` for several sets of columns in one aggregate, each over the rows that have all of its columns: keys, label, n, g."""
    parts = []
    for name, cols in sets.items():
        whole = F.lit(True)
        for c in cols:
            whole = whole & F.col(c).isNotNull()
        sums = [F.sum(F.when(whole, F.col(a) * F.col(b))) for i, a in enumerate(cols) for b in list(cols)[i:]]
        parts.append(F.struct(F.lit(name).alias(label), F.count_if(whole).alias("n"), F.array(*sums).alias("g")))
    return df.groupBy(*keys).agg(F.array(*parts).alias("_z")).select(*keys, F.inline("_z"))


def unpack(g: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = g
    return out + np.triu(out, 1).T


def solve(m: np.ndarray, y: int, xs: Sequence[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares of column y on columns xs from a matrix of products: coefficients, residual sum, inverse."""
    a = m[np.ix_(xs, xs)]
    inv = np.linalg.pinv(a)
    beta = inv @ m[xs, y]
    return beta, float(m[y, y] - beta @ m[xs, y]), inv


def lagged_rows(values: Sequence[Sequence[float]], lags: int) -> np.ndarray:
    """A row (value, 1, its first to ``lags``-th lag, then those of the next column) for each place of a short piece of
    series; 0 where a lag is before the piece."""
    v = np.asarray(values, dtype=float).reshape(len(values), -1)
    out = [v[:, 0], np.ones(len(v))]
    for c in range(v.shape[1]):
        out += [np.concatenate([np.zeros(min(j, len(v))), v[: max(0, len(v) - j), c]]) for j in range(1, lags + 1)]
    return np.stack(out, axis=1)


def granger_screen(long: DataFrame, keys: Sequence[str], order: str, lags: int = 7, least: int = LEAST) -> DataFrame:
    """F test of y on its own lags with and without those of x, for each number of lags: keys, lag, n, f, p.

    Products are summed once, over the rows that have all lags; what a smaller number of lags has besides are each
    cell's first rows, which travel with the sums."""
    past = [f"{c}{j}" for c in "yx" for j in range(1, lags + 1)]
    lagged = lambda d, by: d.withColumns({f"{c}{j}": F.lag(c, j).over(W.partitionBy(*by).orderBy(order)) for c in "yx" for j in range(1, lags + 1)})
    d = complete(long).select(*keys, order, "x", "y", F.lit(1.0).alias("one"))
    d = bounded(d, keys, order, lags, 0, lagged, least, "_rn")
    head = F.array_sort(F.collect_list(F.when(F.col("_rn") <= lags, F.struct("_rn", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))))
    cells = gram(d, keys, ["y", "one", *past], F.col("_rn") > lags, head.alias("head"), F.count(F.lit(1)).alias("rows"))

    @F.pandas_udf("array<struct<lag:int,n:bigint,f:double>>")
    def f_of(rows: pd.Series, g: pd.Series, head: pd.Series) -> pd.Series:
        out = []
        for n_rows, v, first in zip(rows, g, head, strict=True):
            full, cell = unpack(v, 2 + 2 * lags), []
            early = lagged_rows([(r["y"], r["x"]) for r in first], lags)
            for p in range(1, lags + 1):
                m, n = full + early[p:].T @ early[p:], max(int(n_rows) - p, 0)
                own = [1, *range(2, 2 + p)]
                less, more = solve(m, 0, own)[1], solve(m, 0, [*own, *range(2 + lags, 2 + lags + p)])[1]
                free = n - 2 * p - 1
                cell.append({"lag": p, "n": n, "f": ((less - more) / p) / (more / free) if free > 0 and more > 0 else math.nan})
            out.append(cell)
        return pd.Series(out)

    out = cells.withColumn("z", F.explode(f_of("rows", "g", "head"))).select(*keys, "z.*").where("n > 0")
    return out.withColumn("p", f_pvalue("f", "lag", F.col("n") - 2 * F.col("lag") - 1))


#: Response surface of the ADF statistic with a constant (1, 5, 10 %: limit, 1/n, 1/n^2 terms), and KPSS levels with their p.
ADF_CONSTANT = ((0.01, -3.43035, -6.5393, -16.786), (0.05, -2.86154, -2.8903, -4.234), (0.10, -2.56677, -1.5384, -2.809))
KPSS_LEVEL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
#: P of the ADF statistic with a constant is the normal probability of a polynomial, by rising powers; the first up to -1.61, the second to 2.74.
ADF_P = ((2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368))


def adf_pvalue(t: float) -> float:
    if t > 2.74 or t < -18.83:
        return 1.0 if t > 0 else 0.0
    z = sum(c * t**i for i, c in enumerate(ADF_P[0 if t <= -1.61 else 1]))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_lags(n: Column) -> Column:
    """Most lags to try: ceil(12 (n / 100)^(1/4)), and few enough to leave rows."""
    return F.greatest(F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)).cast("int")


def adf_screen(d: DataFrame, keys: Sequence[str], order: str, max_lag: int | None = None, least: int = LEAST) -> DataFrame:
    """ADF with constant of column y, lags by AIC on a common sample, then refitted: keys, n, adf, adf_lag, adf_critical (5 %), adf_p.

    One aggregate over the common sample; the rows that a smaller number of lags has besides are each cell's first ones."""
    d = d.select(*keys, order, F.col("y").cast("double").alias("y"))
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialize(sizes.withColumn("_most", F.lit(max_lag) if max_lag is not None else adf_lags(F.col("_n"))), "lags")
    most = sizes.agg(F.max("_most")).first()[0] or 0

    def lagged(d: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(order)
        d = d.withColumns({"d0": F.col("y") - F.lag("y").over(w), "one": F.lit(1.0), "y1": F.lag("y").over(w)})
        return d.withColumns({f"d{j}": F.coalesce(F.lag("d0", j).over(w), F.lit(0.0)) for j in range(1, most + 1)})

    d = beside(bounded(d, keys, order, most + 1, 0, lagged, least, "_rn"), sizes, keys)
    head = F.array_sort(F.collect_list(F.when(F.col("_rn") <= F.col("_most") + 1, F.struct("_rn", "y"))))
    columns = ["d0", "one", "y1", *[f"d{j}" for j in range(1, most + 1)]]
    cells = gram(d, keys, columns, F.col("_rn") > F.col("_most") + 1, head.alias("head"), F.max("_most").alias("most"), F.max("_n").alias("rows"))

    @F.pandas_udf("adf double, adf_lag int, adf_critical double, adf_p double")
    def adf(rows: pd.Series, tried: pd.Series, g: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for n_rows, top, v, first in zip(rows, tried, g, head, strict=True):
            m, best, nc = unpack(v, 3 + most), (math.inf, 0), int(n_rows) - int(top) - 1
            if nc < 4:
                out.append((None, None, None, None))
                continue
            for p in range(int(top) + 1):
                rss = max(solve(m, 0, list(range(1, 3 + p)))[1], 1e-300)
                best = min(best, (nc * math.log(rss / nc) + 2 * (2 + p), p))
            p = best[1]
            y = np.array([r["y"] for r in first])
            for t in range(p + 1, len(y)):  # rows before the common sample
                step = np.diff(y[: t + 1])[::-1]
                row = np.zeros(3 + most)
                row[: 3 + p] = [step[0], 1.0, y[t - 1], *step[1 : 1 + p]]
                m = m + np.outer(row, row)
            n = int(n_rows) - p - 1
            beta, rss, inv = solve(m, 0, list(range(1, 3 + p)))
            t = beta[1] / math.sqrt(max(rss / max(n - 2 - p, 1) * inv[1, 1], 1e-300))
            _, a, b, c = ADF_CONSTANT[1]
            out.append((t, p, a + b / n + c / n**2, adf_pvalue(t)))
        return pd.DataFrame(out, columns=["adf", "adf_lag", "adf_critical", "adf_p"])

    return cells.withColumn("z", adf("rows", "most", "g", "head")).select(*keys, F.col("rows").alias("n"), "z.*")


def kpss_screen(d: DataFrame, keys: Sequence[str], order: str, least: int = LEAST) -> DataFrame:
    """KPSS of column y around its level: keys, kpss_lags, kpss, kpss_p (clipped to 0.01 and 0.1). The number of lags
    follows the series' own first n^(2/9) autocovariances: 1.1447 (s1 / s0)^(2/3) n^(1/3)."""
    whole = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_mean"))
    e = beside(d.select(*keys, order, "y"), whole, keys).select(*keys, order, "_n", (F.col("y") - F.col("_mean")).alias("e"))
    e = running(e, keys, order, {"_s": "e"}, least=least)
    e = materialize(e.withColumn("_s", F.col("_s") + F.coalesce("e", F.lit(0.0))), "residuals")

    def products(upto: int) -> DataFrame:
        lagged = lambda d, by: d.withColumns({f"_l{j}": F.lag("e", j).over(W.partitionBy(*by).orderBy(order)) for j in range(1, upto + 1)})
        return bounded(e, keys, order, upto, 0, lagged, least).groupBy(*keys).agg(
            F.max("_n").alias("_n"), F.sum(F.col("_s") * F.col("_s")).alias("_eta"), F.sum(F.col("e") * F.col("e")).alias("_g0"),
            F.array(*[F.coalesce(F.sum(F.col("e") * F.col(f"_l{j}")), F.lit(0.0)) for j in range(1, upto + 1)]).cast("array<double>").alias("_g"),
        )

    def weighted(upto: Column, weight) -> Column:
        """Sum over lags j up to ``upto`` of weight(j) g_j."""
        g = F.slice("_g", 1, upto)
        return F.aggregate(F.transform(g, lambda x, i: weight(i + 1) * x), F.lit(0.0), lambda a, x: a + x)

    few = F.floor(F.pow("_n", F.lit(2 / 9))).cast("int")
    n_most = e.agg(F.max("_n")).first()[0] or 0
    first = products(int(math.floor(n_most ** (2 / 9) + 1e-9)))
    s0 = F.col("_g0") / F.col("_n") + weighted(few, lambda j: F.lit(1.0)) * 2 / F.col("_n")
    s1 = weighted(few, lambda j: j.cast("double")) * 2 / F.col("_n")
    auto = F.floor(1.1447 * F.pow(F.pow(s1 / F.nullif(s0, F.lit(0.0)), F.lit(2.0)), F.lit(1 / 3)) * F.pow("_n", F.lit(1 / 3)))
    lags = materialize(first.select(*keys, F.coalesce(F.least(auto, F.col("_n") - 1), F.lit(0)).cast("int").alias("kpss_lags")), "lags")
    found = products(max(1, lags.agg(F.max("kpss_lags")).first()[0] or 0)).join(lags, list(keys))
    s2 = F.col("_g0") + 2 * weighted(F.col("kpss_lags"), lambda j: 1 - j / (F.col("kpss_lags") + 1))
    found = found.select(*keys, "kpss_lags", (F.col("_eta") / (F.col("_n") * F.nullif(s2, F.lit(0.0)))).alias("kpss"))
    (x0, p0), *rest = KPSS_LEVEL
    k, p, steps = F.col("kpss"), F.lit(0.01), []
    for x1, p1 in rest:
        steps.append((x1, p0 + (p1 - p0) * (k - x0) / (x1 - x0)))
        x0, p0 = x1, p1
    for x1, value in reversed(steps):
        p = F.when(k <= x1, value).otherwise(p)
    return found.withColumn("kpss_p", F.when(k <= KPSS_LEVEL[0][0], 0.10).otherwise(p))


def stationarity_screen(long: DataFrame, keys: Sequence[str], order: str, max_lag: int | None = None, least: int = 30) -> DataFrame:
    """ADF and KPSS of column y. A series is stationary if the p of ADF is below 0.05 and that of KPSS above; shorter ones
    than ``least`` count as not. ``max_lag`` replaces the rule for the most lags of ADF."""
    d = long.where("y IS NOT NULL")
    out = adf_screen(d, keys, order, max_lag).join(kpss_screen(d, keys, order), list(keys))
    return out.withColumn("stationary", (F.col("n") >= least) & F.coalesce((F.col("adf_p") < 0.05) & (F.col("kpss_p") > 0.05), F.lit(False)))


def make_stationary(long: DataFrame, keys: Sequence[str], order: str, **settings) -> DataFrame:
    """y, differenced once in the cells that are not stationary as they are."""
    verdict = stationarity_screen(long, keys, order, **settings).select(*keys, "stationary")
    step = lambda d, by: d.withColumn("_d", F.col("y") - F.lag("y").over(W.partitionBy(*by).orderBy(order)))
    joined = bounded(long, keys, order, 1, 0, step).join(verdict, list(keys), "left")
    return joined.withColumn("y", F.when(F.col("stationary"), F.col("y")).otherwise(F.col("_d"))).drop("_d")


def regress_cells(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """OLS with a constant on several regressors: keys, term, beta, se, t, p, n, r2_adj."""
    d = df.withColumns({"_y": F.col(y).cast("double"), "_one": F.lit(1.0)})
    return fit_cells(gram(d, keys, ["_y", "_one", *xs]), keys, xs)


def fit_cells(cells: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Least squares from the products of y, a constant and ``xs``: keys, n, term, beta, se, t, p, r2_adj."""
    names, k = ["const", *xs], len(xs) + 2

    @F.pandas_udf("array<struct<term:string,beta:double,se:double,t:double,p:double,r2_adj:double>>")
    def fit(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for n_, v in zip(n, g, strict=True):
            m = unpack(v, k)
            beta, rss, inv = solve(m, 0, list(range(1, k)))
            free = max(n_ - k + 1, 1)
            se = np.sqrt(np.maximum(rss / free * np.diag(inv), 1e-300))
            tss = m[0, 0] - m[0, 1] ** 2 / n_
            adj = 1 - (rss / free) / (tss / (n_ - 1)) if tss > 0 else math.nan
            ps = t_two_sided(beta / se, np.full(len(beta), free))
            out.append([{"term": a, "beta": b, "se": s, "t": b / s, "p": q, "r2_adj": adj} for a, b, s, q in zip(names, beta.tolist(), se.tolist(), ps.tolist(), strict=True)])
        return pd.Series(out)

    return cells.withColumn("z", F.explode(fit("n", "g"))).select(*keys, "n", "z.*")


def controlled_lag_regression(df: DataFrame, keys: Sequence[str], order: str, y: str, feature: str, control: str, lags: Sequence[int], least: int = LEAST) -> DataFrame:
    """y on its own lag k, the control's and the feature's, for each k, in one pass over the rows; all p values are kept and
    BH-corrected."""
    columns = (("own", y), ("control", control), ("feature", feature))

    def lagged(d: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(order)
        return d.select(*by, "_halo", F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_one"), *[F.lag(c, k).over(w).alias(f"{n}_{k}") for k in lags for n, c in columns])

    rows = bounded(df.select(*dict.fromkeys([*keys, order, y, control, feature])), keys, order, max(lags), 0, lagged, least)
    cells = gram_sets(rows, keys, {k: ["_y", "_one", f"own_{k}", f"control_{k}", f"feature_{k}"] for k in lags}, "lag").where("n > 0")
    return fdr_bh(fit_cells(cells, [*keys, "lag"], ["own", "control", "feature"]).where("term = 'feature'"), keys, "p", ["lag"])


def var_irf(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], lags: int, horizon: int, least: int = LEAST) -> DataFrame:
    """VAR by least squares for each cell and its impulse responses: keys, step, impulse, response, value."""
    k = len(columns)
    past = [(c, j) for j in range(1, lags + 1) for c in columns]
    lagged = lambda d, by: d.select(*by, "_halo", *columns, F.lit(1.0).alias("_one"), *[F.lag(c, j).over(W.partitionBy(*by).orderBy(order)).alias(f"{c}_{j}") for c, j in past])
    d = bounded(df.select(*dict.fromkeys([*keys, order, *columns])), keys, order, lags, 0, lagged, least)
    cells = gram(d, keys, [*columns, "_one", *[f"{c}_{j}" for c, j in past]])

    @F.pandas_udf("array<struct<step:int,impulse:string,response:string,value:double>>")
    def respond(g: pd.Series) -> pd.Series:
        out = []
        for v in g:
            m = unpack(v, k + 1 + k * lags)
            xs = list(range(k, k + 1 + k * lags))
            b = np.stack([solve(m, y, xs)[0][1:] for y in range(k)])
            a = [b[:, j * k : (j + 1) * k] for j in range(lags)]
            psi = [np.eye(k)]
            for h in range(1, horizon + 1):
                psi.append(sum(a[j] @ psi[h - 1 - j] for j in range(min(h, lags))))
            out.append([{"step": h, "impulse": columns[c], "response": columns[r], "value": float(psi[h][r, c])} for h in range(horizon + 1) for r in range(k) for c in range(k)])
        return pd.Series(out)

    return cells.withColumn("z", F.explode(respond("g"))).select(*keys, "z.*")
