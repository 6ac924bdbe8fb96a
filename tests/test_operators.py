"""Edge cases and closed forms of operators on small literal frames."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import annotations as A
from tidemark.functions import dist
from tidemark.functions import text as T
from tidemark.operators import buckets as B
from tidemark.operators import dedup as C
from tidemark.operators import graph as G
from tidemark.operators import joins as D
from tidemark.operators import model as M
from tidemark.operators import series as S
from tidemark.operators import stats as I
from tidemark.operators.components import connected_components
from tidemark.sources import io
from tidemark.streaming import streams as L


def test_sources_round_trip(spark, tmp_path):
    rows = [{"date": "2024-01-01T00:00:00", "channel": "a", "text": "x" * 40, "views": 3}, {"date": "2024-01-02T00:00:00", "channel": "a", "text": "short"}]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "batch_1.json").write_text(json.dumps(rows))
    df = io.read_messages(spark, f"{tmp_path}/*/batch_*.json", least=30)
    assert [(r.views, r.forwards, r.file) for r in df.collect()] == [(3, 0, "batch_1.json")]
    io.write_csv(spark.createDataFrame([(1, 'say "hi"\nthere, you')], "id int, text string"), f"{tmp_path}/csv")
    assert io.read_table_csv(spark, f"{tmp_path}/csv", "id int, text string").first().text == 'say "hi"\nthere, you'
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n  \nnot json\n')
    assert io.read_jsonl(spark, f"{tmp_path}/r.jsonl").count() == 2
    run = spark.createDataFrame([("r", 0.5)], "run string, r2 double")
    io.append_run(run, f"{tmp_path}/ledger")
    io.append_run(run, f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 2
    io.export_graph(run, run, f"{tmp_path}/graph")
    assert spark.read.parquet(f"{tmp_path}/graph/edges").count() == 1


def test_fences_and_quotes(spark):
    df = spark.createDataFrame([('```json\n{"a":1}\n```',), ('see ```{"a":1}```',), ('{"a":1}',), (None,)], "c string")
    assert [r[0] for r in df.select(T.strip_fence("c")).collect()] == ['{"a":1}', 'see ```{"a":1}```', '{"a":1}', None]
    quoted = spark.createDataFrame([('[{"name":"x","ticker":""}]',), ('"[{""name"":""x"",""ticker"":""""}]"',), ("nope",)], "c string")
    got = [r[0] for r in quoted.select(F.transform(T.parse_targets(T.repair_csv_json("c")), lambda t: t["ticker"])).collect()]
    assert got == [[""], [""], []]


def test_validation_finds_first_bad(spark):
    good = {"name": "n", "ticker": None, "type": "CRYPTO", "sentiment": 1, "impact": 5, "category": "X"}
    rows = [([good, {**good, "impact": 11}],), ([good],), ([],), (None,)]
    df = spark.createDataFrame(rows, "targets " + T.TARGETS.simpleString())
    assert [(r.valid, r.first_bad) for r in A.validate_annotations(df).collect()] == [(False, 1), (True, None), (True, None), (False, None)]


def test_asset_target_takes_first_of_equals(spark):
    t = [{"name": "Solid", "ticker": None, "type": None, "sentiment": 1, "impact": 7, "category": None}, {"name": "x", "ticker": "sol", "type": None, "sentiment": -1, "impact": 7, "category": "C"}]
    msgs = spark.createDataFrame([(1, t)], "msg_id int, targets " + T.TARGETS.simpleString())
    assets = spark.createDataFrame([("SOL", ["SOL"], ["sol"])], "asset string, tickers array<string>, aliases array<string>")
    got = C.select_asset_target(msgs, assets).first()
    assert (got.pos, got.sentiment, got.category) == (0, 1, "UNKNOWN")
    assert C.select_asset_target(msgs, assets, whole_word=True).first().pos == 1


def test_null_fact_counts_in_neither(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None, "x", 1, 1), ("a", -1.0, 2.0, True, "x", 1, 1)], "asset string, sentiment double, impact double, is_fact boolean, category string, views int, forwards int")
    r = df.groupBy("asset").agg(*B.fact_opinion()).first()
    assert (r.volume_fact, r.volume_opinion, r.fact_ratio, r.sentiment_fact) == (1, 0, 1.0, -1.0)
    zero = spark.createDataFrame([("a", 1.0, 0.0)], "asset string, sentiment double, impact double")
    assert zero.groupBy("asset").agg(B.weighted_avg("sentiment", "impact").alias("w")).first().w == 0.0


def test_gaps_and_windows(spark):
    df = spark.createDataFrame([("s", t, float(t)) for t in (0, 1, 2, 103, 104)], "symbol string, t bigint, v double")
    got = df.select("t", S.diff("v", 1, ["symbol"], "t", 1).alias("d")).orderBy("t").collect()
    assert [r.d for r in got] == [None, 1.0, 1.0, None, 1.0]
    assert S.sequence_windows(df, ["v"], 3, ["symbol"], "t", 1).count() == 1
    grid = S.complete_grid(df, ["symbol"], "t")
    assert grid.count() == 105 and grid.where("observed").count() == 5


def test_asof_prefers_later_of_equals(spark):
    left = spark.createDataFrame([("k", 10), ("k", 100)], "k string, t bigint")
    right = spark.createDataFrame([("k", 8, 1.0), ("k", 12, 2.0), ("k", 300, 3.0)], "k string, t bigint, v double")
    got = {r.t: r.v for r in D.asof_nearest(left, right, ["k"], "t", "v", 50).collect()}
    assert got == {10: 2.0, 100: None}


def test_gini_is_that_of_sorted_values(spark):
    df = spark.createDataFrame([("w", "a", 1.0), ("w", "b", 3.0), ("w", "c", 2.0)], "w string, node string, x double")
    assert abs(G.gini(df, "x", ["w"], "node").first().gini - 2 / 9) < 1e-12


def test_fold_sizes(spark):
    f = M.walk_forward(spark.range(1387).withColumnRenamed("id", "t"), 5, [], "t")
    sizes = {(r.fold, r.role): r["count"] for r in f.groupBy("fold", "role").count().collect()}
    assert [sizes[k, "train"] for k in range(1, 6)] == [232, 463, 694, 925, 1156]
    assert all(sizes[k, "test"] == 231 for k in range(1, 6))


def test_tail_probabilities():
    assert np.allclose(dist.t_two_sided([2.228], [10]), 0.05, atol=1e-4)
    assert np.allclose(dist.betainc(5, 1, 10 / (10 + 1 * 4.9646)), 1 - (1 - (10 / 14.9646) ** 5), atol=1e-12)
    assert np.allclose(dist.gammainc_upper(0.5, 3.841 / 2), 0.05, atol=1e-4)
    assert np.allclose(dist.gammainc_upper(0.5, 0.1 / 2), math.erfc(math.sqrt(0.05)), atol=1e-10)


def test_granger_and_regression_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = np.concatenate([[0], 0.5 * x[:-1]]) + rng.normal(size=200)
    df = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "cell string, t int, x double, y double")
    got = {r.lag: r for r in I.granger_screen(df, ["cell"], "t", 2).collect()}
    for p in (1, 2):
        n = 200 - p
        own = np.column_stack([np.ones(n), *[y[p - j : 200 - j] for j in range(1, p + 1)]])
        both = np.column_stack([own, *[x[p - j : 200 - j] for j in range(1, p + 1)]])
        rss = [np.linalg.lstsq(m, y[p:], rcond=None)[1][0] for m in (own, both)]
        f = (rss[0] - rss[1]) / p / (rss[1] / (n - 2 * p - 1))
        assert abs(got[p].f - f) < 1e-6 * f and got[p].p < 1e-4
    beta = {r.term: r.beta for r in I.regress_cells(df, ["cell"], "y", ["x"]).collect()}
    assert np.allclose([beta["const"], beta["x"]], np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0])


def test_stationarity_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=400)
    rows = [("noise", i, float(v)) for i, v in enumerate(noise)] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(noise))]
    got = {r.cell: r.stationary for r in I.stationarity_screen(spark.createDataFrame(rows, "cell string, t int, y double"), ["cell"], "t").collect()}
    assert got == {"noise": True, "walk": False}


def test_lasso_follows_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, 0, -2, 0] + rng.normal(size=300)
    b = M.coordinate_descent(x.T @ x, x.T @ y, 300, 0.1, 1.0, np.zeros(4))
    slope = x.T @ (y - x @ b) / 300
    assert np.all(np.abs(slope) <= 0.1 + 1e-8) and np.allclose(slope[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-7)


def test_unknown_features_are_refused(spark):
    with pytest.raises(ValueError, match="unknown"):
        M.assemble(spark.range(3), ["nope"])


def test_graph_algorithms(spark):
    # two triangles joined by a bridge
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("d", "f", 1), ("e", "f", 1)], "src string, dst string, weight int")
    assert G.triangles(e).first().triangles == 2
    assert abs(G.transitivity(e).first().transitivity - 6 / 10) < 1e-12
    bc = {r.node: r.betweenness for r in G.betweenness(e, sources=6).collect()}
    assert all(abs(bc[n] - v) < 1e-9 for n, v in {"a": 0, "b": 0, "c": 0.6, "d": 0.6, "e": 0, "f": 0}.items())
    pr = {r.node: r.rank for r in G.pagerank(e).collect()}
    m = np.zeros((6, 6))
    for r in e.collect():
        i, j = ord(r.src) - 97, ord(r.dst) - 97
        m[i, j] = m[j, i] = 1
    p = np.full(6, 1 / 6)
    for _ in range(200):
        p = 0.15 / 6 + 0.85 * (m / m.sum(0)) @ p
    assert all(abs(pr[chr(97 + i)] - p[i]) < 1e-5 for i in range(6))
    labels = G.communities(e)
    assert G.modularity(e, labels).first().modularity >= 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 150")
    got = connected_components(chain)
    assert got.count() == 301 and got.select("root").distinct().count() == 2
    assert connected_components(chain.where("a < 0")).count() == 0


def test_novelty(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, 0, a), (2, 1, a), (3, 2, a.replace("w30", "x")), (4, 40, a), (5, 1, "other words altogether here now")]
    got = {r.msg_id: r.status for r in G.text_novelty(spark.createDataFrame(rows, "msg_id int, day int, text string"), "day", 7, 0.5).collect()}
    assert got == {1: "new", 2: "reprint", 3: "update", 4: "new", 5: "new"}


def test_upsert_keeps_the_latest(spark, tmp_path):
    one = spark.createDataFrame([(1, "2024-01-01 00:00:00", "old"), (2, "2024-01-01 00:00:00", "two")], "id int, ts string, v string")
    two = spark.createDataFrame([(1, "2024-01-02 00:00:00", "new")], "id int, ts string, v string")
    one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    two.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    L.upsert_sink(stream, f"{tmp_path}/out", "id", f"{tmp_path}/state").start().awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "list").iterdir())
    assert {r.id: r.v for r in L.read_upserts(spark, f"{tmp_path}/out", one.schema, last).collect()} == {1: "new", 2: "two"}
    versions = L.bucket_versions(spark, f"{tmp_path}/out", last)
    assert sorted(versions.values()) == [0, 1]  # the bucket that the second batch did not hit is as it was


def test_late_rows_are_counted(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0, 1.0), ("2024-01-03 00:00:00", "a", 1.0, 1.0), ("2024-01-03 01:00:00", "a", 1.0, 1.0), ("2024-01-01 01:00:00", "a", 1.0, 1.0), ("2024-01-04 00:00:00", "a", 1.0, 1.0)]
    for r in rows:  # rows are late by the watermark that the batch before began with
        df = spark.createDataFrame([r], "ts string, asset string, sentiment double, impact double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = L.tumbling_sentiment(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert L.dropped_late(query) == 1 and spark.table("late").count() == 3


def test_hooks(spark):
    from tidemark.functions import hooks

    df = spark.createDataFrame([("good good bad",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(hooks.text_scorer(hooks.lexicon())("t")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]
    v = [r[0] for r in df.select(hooks.text_embedder(hooks.hashed_counts(8))("t")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[1] == [0.0] * 8


def test_inversions_in_high_bits(spark):
    rows = [("a", 1.0, 1 << 21), ("a", 2.0, 3), ("a", 3.0, (1 << 21) + 1), ("a", 4.0, 0), ("b", 1.0, 0), ("b", 2.0, 0)]
    got = {r.c: r._d for r in I.inversions(spark.createDataFrame(rows, "c string, x double, _q int"), ["c"]).collect()}
    assert got == {"a": 4, "b": 0}
