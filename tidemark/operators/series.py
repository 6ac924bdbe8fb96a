"""Time-series operators, partitioned by keys and ordered by a time column.

Frames count rows unless a step is given; with a step, a value counts only where the row it comes from is exactly that
far away, so gaps give null instead of a wrong neighbour. Use ``complete_grid`` first to give every hour a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranges import LEAST, beside, bounded, key_medians, running, value_counts
from tidemark.scratch import materialize


def _w(keys: Sequence[str], order: str):
    return W.partitionBy(*keys).orderBy(order)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corr(x: Column | str, y: Column | str, over=None) -> Column:
    """Pearson correlation, over a window if one is given; null where either side does not vary."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    parts = [F.covar_pop(x, y), F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))]
    c, vx, vy = parts if over is None else [p.over(over) for p in parts]
    return c / F.nullif(F.sqrt(vx * vy), F.lit(0.0))


def shifted(c: Column | str, k: int, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    """Value ``k`` rows back (ahead if negative); with ``step``, only if its row is ``k`` steps away."""
    w = _w(keys, order)
    value = F.lag(_col(c), k).over(w)
    return value if step is None else F.when(F.col(order) - F.lag(order, k).over(w) == k * step, value)


def diff(c: str, k: int, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    return F.col(c) - shifted(c, k, keys, order, step)


def second_diff(c: str, keys: Sequence[str], order: str) -> Column:
    return F.col(c) - 2 * shifted(c, 1, keys, order) + shifted(c, 2, keys, order)


def rolling_mean(c: str, w: int, keys: Sequence[str], order: str) -> Column:
    """Mean of up to ``w`` rows."""
    return F.avg(c).over(_w(keys, order).rowsBetween(1 - w, 0))


def momentum(c: str, w: int, keys: Sequence[str], order: str) -> Column:
    return F.col(c) - rolling_mean(c, w, keys, order)


def returns(c: str, k: int, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    return F.col(c) / F.nullif(shifted(c, k, keys, order, step), F.lit(0.0)) - 1


def log_return(c: str, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    before = shifted(c, 1, keys, order, step)
    return F.when((before > 0) & (F.col(c) > 0), F.log(F.col(c) / before))


def range_vol() -> Column:
    return (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0))


def rolling_vol(r: str, w: int, keys: Sequence[str], order: str, periods: float = 1.0) -> Column:
    """Sample deviation of ``w`` values, null where fewer are there; scaled by the root of ``periods``."""
    over = _w(keys, order).rowsBetween(1 - w, 0)
    return F.when(F.count(r).over(over) == w, F.stddev_samp(r).over(over)) * math.sqrt(periods)


def forward_change(c: str, h: int, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    return shifted(c, -h, keys, order, step) - F.col(c)


def forward_value(c: Column | str, h: int, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    return shifted(c, -h, keys, order, step)


def forward_realized_vol(r: str, w: int, keys: Sequence[str], order: str) -> Column:
    over = _w(keys, order).rowsBetween(1, w)
    return F.when(F.count(r).over(over) == w, F.stddev_samp(r).over(over))


def lag_matrix(df: DataFrame, c: str, lags: Sequence[int], keys: Sequence[str], order: str, step: int = 1) -> DataFrame:
    """Long table keys, order, lag, value: the value ``lag`` steps before, where there is one (equi join on time)."""
    past = df.select(*keys, F.col(order).alias("_t"), F.col(c).alias("value")).withColumn("lag", F.explode(F.lit(list(lags)).cast("array<int>")))
    past = past.select(*keys, (F.col("_t") + F.col("lag") * step).alias(order), "lag", "value")
    return df.select(*keys, order).join(past, [*keys, order])


def spike_flags(df: DataFrame, c: str, ks: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """spike_<k> for each k: above mean + k sample deviations of the key's whole series; without keys, of all rows."""
    stats = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    flags = {f"spike_{str(k).replace('.', '_')}": F.col(c) > F.col("_m") + k * F.col("_s") for k in ks}
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns(flags).drop("_m", "_s")


def causal_spikes(df: DataFrame, c: str, k: float, keys: Sequence[str], order: str, name: str = "causal", least: int = LEAST) -> DataFrame:
    """``name``: above mean + k sample deviations of the key's rows before; false where fewer than two are there. Null values do
    not count. Moments are running sums of the height above the key's least value, carried from piece to piece."""
    d = beside(df, df.groupBy(*keys).agg(F.min(c).alias("_low")), keys).withColumn("_v", (F.col(c) - F.col("_low")).cast("double"))
    d = d.withColumns({"_one": F.col("_v").isNotNull().cast("long"), "_vv": F.col("_v") * F.col("_v")})
    d = running(d, keys, order, {"_n": "_one", "_s": "_v", "_ss": "_vv"}, least=least)
    several = F.when(F.col("_n") > 1, F.col("_n"))
    spread = F.sqrt(F.greatest((F.col("_ss") - F.col("_s") * F.col("_s") / several) / (several - 1), F.lit(0.0)))
    flag = F.coalesce(F.col("_v") > F.col("_s") / several + k * spread, F.lit(False))
    return d.withColumn(name, flag).drop("_low", "_v", "_one", "_vv", "_n", "_s", "_ss")


def zscore_mask(df: DataFrame, columns: Sequence[str], z: float, keys: Sequence[str]) -> DataFrame:
    """outlier: any column further than ``z`` population deviations from its key's mean."""
    stats = df.groupBy(*keys).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.coalesce(F.abs(F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) > z, F.lit(False))
    return df.join(stats, list(keys)).withColumn("outlier", any_of).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def winsorize(df: DataFrame, c: str, p: float, keys: Sequence[str], tie: str | None = None, least: int = LEAST) -> DataFrame:
    """``c`` clamped to its order statistics with int(p * n) values cut off at each end; they are found from counts of values,
    so ``tie`` decides nothing."""
    counts = value_counts(df, keys, c, least)
    n = counts.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    cuts = F.floor(F.col("_n") * p)
    ends = counts.join(n, list(keys)).groupBy(*keys).agg(F.min(F.when(F.col("_below") + F.col("_k") > cuts, F.col(c))).alias("_lo"), F.max(F.when(F.col("_below") < F.col("_n") - cuts, F.col(c))).alias("_hi"))
    return df.join(ends, list(keys)).withColumn(c, F.least(F.greatest(c, "_lo"), "_hi")).drop("_lo", "_hi")


def regime_flags(df: DataFrame, c: str, vol: str, w: int, keys: Sequence[str], order: str, least: int = LEAST) -> DataFrame:
    """bull: above the ``w``-row mean; above_median, high_vol: above the key's median."""
    medians = key_medians(df, keys, {c: "_c", vol: "_v"}, least)
    bull = lambda d, by: d.withColumn("bull", F.col(c) > rolling_mean(c, w, by, order))
    flagged = beside(bounded(df, keys, order, w - 1, 0, bull, least), medians, keys)
    return flagged.withColumns({"above_median": F.col(c) > F.col("_c"), "high_vol": F.col(vol) > F.col("_v")}).drop("_c", "_v")


def rolling_corr(x: str, y: str, w: int, keys: Sequence[str], order: str) -> Column:
    over = _w(keys, order).rowsBetween(1 - w, 0)
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(over) == w, corr(x, y, over))


def rolling_avg_pair_corr(long: DataFrame, c: str, w: int, entity: str, order: str, least: int = LEAST) -> DataFrame:
    """Mean over entity pairs of their correlation over the ``w`` rows before, by time. Entities are a fixed small set."""
    a = long.select(F.col(entity).alias("_a"), order, F.col(c).alias("_x"))
    b = long.select(F.col(entity).alias("_b"), order, F.col(c).alias("_y"))
    pairs = materialize(a.join(b, order).where("_a < _b AND _x IS NOT NULL AND _y IS NOT NULL"), "pairs")

    def rolled(d: DataFrame, by: list[str]) -> DataFrame:
        over = _w(by, order).rowsBetween(-w, -1)
        return d.withColumn("_r", F.when(F.count(F.lit(1)).over(over) == w, corr("_x", "_y", over)))

    return bounded(pairs, ["_a", "_b"], order, w, 0, rolled, least).groupBy(order).agg(F.avg("_r").alias("avg_corr"))


def rebased_share(long: DataFrame, c: str, entity: str, order: str) -> DataFrame:
    """index: 100 at the entity's first time; share: of the time's total."""
    first = long.groupBy(entity).agg(F.min_by(c, order).alias("_first"))
    total = long.groupBy(order).agg(F.sum(c).alias("_total"))
    d = beside(beside(long, first, [entity]), total, [order])
    return d.withColumns({"index": 100 * F.col(c) / F.col("_first"), "share": F.col(c) / F.col("_total")}).drop("_first", "_total")


def autocorr(df: DataFrame, c: str, lags: Sequence[int], keys: Sequence[str], order: str, least: int = LEAST) -> DataFrame:
    """Correlation with the series ``lag`` rows back: keys, lag, r; all lags in one aggregate, long series in pieces."""
    lagged = lambda d, by: d.select(*by, "_halo", F.col(c).alias("_x"), *[F.lag(c, k).over(_w(by, order)).alias(f"_{k}") for k in lags])
    wide = bounded(df.select(*dict.fromkeys([*keys, order, c])), keys, order, max(lags), 0, lagged, least)
    long = wide.select(*keys, "_x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("_y")) for k in lags])).alias("z")).select(*keys, "_x", "z.*")
    return long.where("_x IS NOT NULL AND _y IS NOT NULL").groupBy(*keys, "lag").agg(corr("_x", "_y").alias("r"))


def persistence(c: str, keys: Sequence[str], order: str, step: int | None = None) -> Column:
    return F.coalesce(shifted(c, 1, keys, order, step), F.lit(0.0))


def sequence_windows(df: DataFrame, columns: Sequence[str], length: int, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """The last ``length`` rows as an array, only where they are consecutive."""
    over = _w(keys, order).rowsBetween(1 - length, 0)
    seq = df.withColumn("window", F.collect_list(F.struct(order, *columns)).over(over))
    whole = (F.size("window") == length) & (F.col(order) - F.col("window")[0][order] == (length - 1) * step)
    return seq.where(whole)


def consecutive_slices(df: DataFrame, n: int, keys: Sequence[str], order: str, least: int = LEAST) -> DataFrame:
    """slice 0 to n - 1 of equal length in time order; the last takes the remainder."""
    sizes = df.groupBy(*keys).agg(F.greatest(F.floor(F.count(F.lit(1)) / n), F.lit(1)).alias("_size"))
    placed = beside(bounded(df, keys, order, 0, 0, lambda d, by: d, least, "_rn"), sizes, keys)
    return placed.withColumn("slice", F.least(F.floor((F.col("_rn") - 1) / F.col("_size")), F.lit(n - 1)).cast("int")).drop("_rn", "_size")


def cross_section_mean(long: DataFrame, c: str, order: str) -> DataFrame:
    return long.groupBy(order).agg(F.avg(c).alias("mean"))


def coverage_report(df: DataFrame, keys: Sequence[str], order: str, step: int = 1) -> DataFrame:
    """Rows present, steps spanned, their ratio, the largest gap and the number of gaps other than one step."""
    gaps = df.withColumn("_g", F.col(order) - F.lag(order).over(_w(keys, order)))
    span = (F.max(order) - F.min(order)) / step + 1
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"), span.cast("bigint").alias("span"), (F.count(F.lit(1)) / span).alias("coverage"),
        F.max("_g").alias("max_gap"), F.count_if(F.col("_g") != step).alias("n_gaps"),
    )


def complete_grid(df: DataFrame, keys: Sequence[str], order: str, step: int = 1) -> DataFrame:
    """A row for every step between each key's first and last; observed tells which were there."""
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("bigint"))).alias(order))
    return grid.join(df.withColumn("observed", F.lit(True)), [*keys, order], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def coverage_intervals(collected: DataFrame, keys: Sequence[str], time: str, gap: int) -> DataFrame:
    """(keys, first, last): runs of collection times at most ``gap`` apart; repeated times count once."""
    times = collected.select(*keys, time).distinct()
    w = _w(keys, time)
    run = times.withColumn("_new", F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1)))
    run = run.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last")).drop("_run")


def hour_states(grid: DataFrame, intervals: DataFrame, keys: Sequence[str], hour: str, step: int = 3600) -> DataFrame:
    """``grid`` (with ``observed``) and state: observed, empty (no rows, though a source was collected in that hour) or
    uncovered (nothing was collected, so that it is not known whether there was anything).

    Intervals are cut to hours by differences: +1 at the first hour, -1 after the last one, and a running sum over the hours
    at which something changes, so overlapping intervals of many sources cost two rows each.
    """
    at = lambda c: F.floor(F.col(c) / step).cast("long")
    change = lambda c, v: F.struct(c.alias(hour), F.lit(v).alias("_d"))
    moves = intervals.select(*keys, F.inline(F.array(change(at("first"), 1), change(at("last") + 1, -1)))).groupBy(*keys, hour).agg(F.sum("_d").alias("_d"))
    held = running(grid.join(moves, [*keys, hour], "full_outer").withColumn("_d", F.coalesce("_d", F.lit(0))), keys, hour, {"_before": "_d"})
    covered = F.col("_before") + F.col("_d") > 0
    state = F.when(F.col("observed"), "observed").when(covered, "empty").otherwise("uncovered")
    return held.where("observed IS NOT NULL").withColumn("state", state).drop("_before", "_d")


def future_realized_variance(r: str, horizon: int, keys: Sequence[str], order: str) -> Column:
    """Sum of squared returns over the next ``horizon`` steps, null unless all of them are there."""
    over = _w(keys, order).rangeBetween(1, horizon)
    return F.when(F.count(r).over(over) == horizon, F.sum(F.col(r) * F.col(r)).over(over))


def past_risk(r: str, horizon: int, keys: Sequence[str], order: str) -> Column:
    """Root of the mean squared return over the last ``horizon`` steps that are there."""
    return F.sqrt(F.avg(F.col(r) * F.col(r)).over(_w(keys, order).rangeBetween(1 - horizon, 0)))
