"""Regression trees of all cells at once, grown level by level from histograms.

A cell (an asset and fold, say) is a key. Each level of all trees of all cells is one Spark aggregate over (cell, tree, node,
feature, bin), so the number of jobs grows with the depth of the trees and not with the number of cells; rows are read,
binned and written once. Bags are Poisson weights by the hash of the row and the tree: nothing is copied or collected.
Splits maximise the fall of the weighted squared error, which for labels 0 and 1 is that of the Gini impurity, too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import materialize


@dataclass(frozen=True)
class Trees:
    """nodes: by, tree, node (1 is the root, 2n and 2n + 1 the children of n), f and bin of its split (null in a leaf), value, weight,
    gain; cuts: by and, for each feature, the upper ends of its bins."""

    nodes: DataFrame
    cuts: DataFrame
    by: tuple[str, ...]
    features: tuple[str, ...]
    depth: int
    rate: float  # weight of each tree but the first; 0 for the mean of all


def poisson_weight(draw: Column) -> Column:
    """A Poisson(1) number from a 64-bit hash."""
    u = F.pmod(draw, F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k + 1
    return weight


def _whole(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all columns are numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok)


def _binned(cuts: Column, x: Column) -> Column:
    """For each feature the number of its cuts below the value."""
    return F.zip_with(cuts, x, lambda ends, v: F.size(F.filter(ends, lambda e: e < v)))


def _reached(splits: str, bins: str, depth: int) -> Column:
    """The node that a row comes to in at most ``depth`` steps."""
    if not depth:
        return F.lit(1)
    step = f"n * 2 + IF(get({bins}, element_at({splits}, n).f) > element_at({splits}, n).bin, 1, 0)"
    return F.expr(f"aggregate(sequence(1, {depth}), 1, (n, k) -> IF(element_at({splits}, n).f IS NULL, n, {step}))")


def _splits(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, tree and its nodes as a map."""
    return nodes.groupBy(*by, "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "bin", "value")))).alias("_splits"))


def _grow(rows: DataFrame, by: Sequence[str], n_features: int, trees: int, depth: int, least: int, tried: int, bag: bool, seed: int) -> DataFrame:
    """Nodes of ``trees`` trees for each cell. ``rows``: by, _h (hash of the row), _b (bins), _y, _w."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    known = None
    weight = F.col("_w") * poisson_weight(F.xxhash64("_h", "tree", F.lit(seed))) if bag else F.col("_w")
    for level in range(depth + 1):
        if known is None:
            at = rows.select("*", tree).withColumn("node", F.lit(1))
        else:
            at = rows.join(_splits(known, by), list(by)).withColumn("node", _reached("_splits", "_b", level)).where(F.col("node") >= 1 << level)
        at = at.withColumn("_w", weight).where("_w > 0")
        sums = [F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("s")]
        if level == depth:
            new = at.groupBy(*by, "tree", "node").agg(*sums).select(*by, "tree", "node", F.lit(None).cast("int").alias("f"), F.lit(None).cast("int").alias("bin"), (F.col("s") / F.col("w")).alias("value"), F.col("w").alias("weight"), F.lit(0.0).alias("gain"))
        else:
            cells = at.select(*by, "tree", "node", "_w", "_y", F.posexplode("_b").alias("f", "bin")).groupBy(*by, "tree", "node", "f", "bin").agg(*sums, F.count(F.lit(1)).alias("n"))
            of = W.partitionBy(*by, "tree", "node", "f")
            left = of.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
            cells = cells.select(*by, "tree", "node", "f", "bin", *[F.sum(c).over(left).alias(f"l{c}") for c in ("w", "s", "n")], *[F.sum(c).over(of).alias(c) for c in ("w", "s", "n")])
            r = {c: F.col(c) - F.col(f"l{c}") for c in ("w", "s", "n")}
            gain = F.col("ls") * F.col("ls") / F.col("lw") + r["s"] * r["s"] / F.nullif(r["w"], F.lit(0.0)) - F.col("s") * F.col("s") / F.col("w")
            order = lambda f: F.xxhash64("tree", "node", f, F.lit(seed))
            chosen = F.size(F.filter(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda g: order(g) < order(F.col("f")))) < tried
            fits = (F.col("ln") >= least) & (r["n"] >= least) & chosen
            gain = F.when(fits, gain)
            # of equal gains the first feature and cut; a gain of rounding alone is none
            top = F.max_by(F.struct("f", "bin", gain.alias("gain")), F.struct(F.coalesce(gain, F.lit(-1.0)).alias("g"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("b")))
            best = cells.groupBy(*by, "tree", "node").agg(top.alias("t"), F.first("w").alias("w"), F.first("s").alias("s"))
            real = F.coalesce(F.col("t.gain") > 1e-12 * (1 + F.col("s") * F.col("s") / F.col("w")), F.lit(False))
            new = best.select(*by, "tree", "node", F.when(real, F.col("t.f")).alias("f"), F.when(real, F.col("t.bin")).alias("bin"), (F.col("s") / F.col("w")).alias("value"), F.col("w").alias("weight"), F.when(real, F.col("t.gain")).otherwise(0.0).alias("gain"))
        new = materialize(new, "nodes")
        known = new if known is None else known.unionByName(new)
        if level < depth and new.where("f IS NOT NULL").isEmpty():
            break
    return known


def fit_trees(
    train: DataFrame, by: Sequence[str], features: Sequence[str], y: str, trees: int = 20, depth: int = 5, bins: int = 32,
    least: int = 1, share: float = 1.0, weight: str | None = None, bag: bool = True, rate: float = 0.0, seed: int = 7,
) -> Trees:
    """Trees of every cell ``by``: a bagged forest, or, with a ``rate``, a boosted sequence in which each tree fits what those
    before leave (the first counts whole, the others times ``rate``).

    Each feature is cut at up to ``bins`` - 1 quantiles of its cell; a node tries the ``share`` of features of lowest
    hash. A leaf has at least ``least`` rows. Rows with a null or NaN in y or a feature are left out; rows equal in
    all columns share their bags. A cell without rows has no trees.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    given = _whole(train, [*features, y]).select(*by, F.xxhash64(*train.columns).alias("_h"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    given = materialize(given, "train")
    ends = [F.array_sort(F.array_distinct(F.percentile_approx(F.get("_x", F.lit(i)), [k / bins for k in range(1, bins)], 10_000))) for i in range(len(features))]
    cuts = materialize(given.groupBy(*by).agg(F.array(*ends).alias("_cuts")), "cuts")
    rows = materialize(given.join(cuts, by).select(*by, "_h", _binned(F.col("_cuts"), F.col("_x")).alias("_b"), "_y", "_w"), "binned")
    tried = max(1, round(share * len(features)))
    if not rate:
        nodes = _grow(rows, by, len(features), trees, depth, least, tried, bag, seed)
    else:
        nodes = None
        for k in range(trees):
            own = _grow(rows, by, len(features), 1, depth, least, tried, False, seed + k)
            step = 1.0 if k == 0 else rate
            left = rows.join(_splits(own, by), by).withColumn("_at", _reached("_splits", "_b", depth))
            rows = materialize(left.select(*by, "_h", "_b", (F.col("_y") - step * F.expr("element_at(_splits, _at).value")).alias("_y"), "_w"), "residuals")
            own = own.withColumn("tree", F.lit(k))
            nodes = own if nodes is None else nodes.unionByName(own)
    return Trees(nodes, cuts, tuple(by), tuple(features), depth, rate)


def predict_trees(df: DataFrame, fit: Trees, name: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its cell's trees. Rows with a null or NaN feature, and cells without trees, are left out."""
    by = list(fit.by)
    packed = _splits(fit.nodes, by).join(fit.cuts, by)
    rows = _whole(df, fit.features).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "test")
    x = F.array(*[F.col(c).cast("double") for c in fit.features])
    each = rows.select(*by, "_row", x.alias("_x")).join(packed, by).withColumn("_b", _binned(F.col("_cuts"), F.col("_x"))).withColumn("_at", _reached("_splits", "_b", fit.depth))
    value = F.expr("element_at(_splits, _at).value")
    total = F.sum(value * F.when(F.col("tree") == 0, 1.0).otherwise(fit.rate)) if fit.rate else F.avg(value)
    return rows.join(each.groupBy("_row").agg(total.alias(name)), "_row").drop("_row")


def importances(fit: Trees) -> DataFrame:
    """by, feature, value: a tree's share of gain that a feature brings, averaged over the cell's trees that have splits."""
    by = list(fit.by)
    names = F.array(*[F.lit(c) for c in fit.features])
    gains = fit.nodes.where("f IS NOT NULL").groupBy(*by, "tree", "f").agg(F.sum("gain").alias("g"))
    shares = gains.withColumn("g", F.col("g") / F.sum("g").over(W.partitionBy(*by, "tree")))
    grown = shares.groupBy(*by).agg(F.countDistinct("tree").alias("_n"))
    found = shares.groupBy(*by, "f").agg(F.sum("g").alias("_g")).join(grown, by).select(*by, "f", (F.col("_g") / F.col("_n")).alias("value"))
    every = fit.cuts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(fit.features) - 1))).alias("f"))
    return every.join(found, [*by, "f"], "left").select(*by, F.get(names, F.col("f")).alias("feature"), F.coalesce("value", F.lit(0.0)).alias("value"))
