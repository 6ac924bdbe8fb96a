"""Queries that must read whole tables: every symbol, every window, every event."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.operators import model as M
from tidemark.plans import catalog, fixtures

FITS = {"j5_linear_models": 5, "j6_nested_linear_cv": 5, "j7_tree_models": 5, "j8_spike_classifier": 5, "j13_top_coefficients": 0, "j14_ablation": 5, "j15_horizon_sweep": 0, "j16_univariate_fit": 0, "d7_events_before_spikes": 0}


@pytest.mark.parametrize("name", sorted(FITS))
def test_every_symbol_and_fold(spark, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    cells = {r[0] for r in fixtures.view(spark, SMALL, "v_bars").select("symbol").distinct().collect()}
    assert set(got["symbol" if "symbol" in got else "cell"]) == cells and len(cells) == 3
    if folds := FITS[name]:
        assert set(zip(got["cell"], got["fold"], strict=True)) == {(c, f) for c in cells for f in range(1, folds + 1)}


def test_trees_are_the_operators_defaults(spark, monkeypatch):
    seen = []
    plain = M.regressor
    monkeypatch.setattr(M, "regressor", lambda *a, **k: seen.append(k) or plain(*a, **k))
    catalog.QUERIES["j13_top_coefficients"](spark, SMALL)
    assert seen and not any("trees" in k for k in seen)


def test_cells_are_fitted_apart(spark):
    rows = [(c, i, float(i % 7), s * float(i % 7) + 1) for c, s in (("p", 2.0), ("q", -3.0), ("short", 1.0)) for i in range(60 if c != "short" else 3)]
    df = spark.createDataFrame(rows, "cell string, day int, x double, y double")
    one = M.nested_linear_cv(df.where("cell = 'q'"), ["x"], "y", "day", [0.001]).orderBy("fold").collect()
    both = M.nested_linear_cv(df.where("cell <> 'short'"), ["x"], "y", "day", [0.001], keys=["cell"]).where("cell = 'q'").orderBy("fold").collect()
    assert [r.betas for r in one] == [r.betas for r in both] and all(abs(r.betas[0] + 3) < 0.01 for r in both)
    preds = M.fit_predict(M.walk_forward(df, 5, ["cell"], "day"), ["x"], "y", "linear", ["cell"])
    assert {r.cell for r in preds.select("cell").distinct().collect()} == {"p", "q"}
    assert preds.where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0
    labelled = M.walk_forward(df.withColumn("y", F.lit(0.0)), 2, ["cell"], "day").where("cell = 'p'")
    assert {r.score for r in M.fit_spike_classifier(labelled, ["x"], "y", ["cell"]).collect()} == {0.0}


@pytest.mark.parametrize("name", ["l1_stream_tumbling", "l2_stream_sliding"])
def test_last_windows_are_there(spark, name):
    col = "hr" if name.startswith("l1") else "win"
    last = fixtures.view(spark, SMALL, "v_signal").agg(F.max("hr")).first()[0]
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert got[col].max() == last + (0 if col == "hr" else 24)
    assert got["asset" if col == "hr" else "category"].notna().all()


def test_fill_takes_every_signal(spark):
    want = {(r.asset, r.hr): r.k for r in fixtures.view(spark, SMALL, "v_signal").groupBy("asset", "hr").agg(F.max("k").alias("k")).collect()}
    got = {(r.symbol, r.hr): r.k for r in catalog.QUERIES["d4_join_ffill"](spark, SMALL).collect()}
    assert {h: got[h] for h in want} == want and len(got) > len(want)
