"""Findings of round 3."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph as G
from tidemark.streaming import streams as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_triangles_broadcast_nothing_but_range_starts(spark):
    rows = [(k, f"n{i}", f"n{j}") for k in range(3) for i in range(6) for j in range(i + 1, 6) if (i + j + k) % 4]
    e = spark.createDataFrame(rows, "w int, src string, dst string")
    got = G.triangles(e, ["w"])
    assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)
    edges = {k: {(a, b) for w, a, b in rows if w == k} for k in range(3)}
    want = {k: sum((a, b) in s and (b, c) in s and (a, c) in s for a in x for b in x for c in x if a < b < c) for k, s in edges.items() for x in [{n for p in s for n in p}]}
    assert {r.w: r.triangles for r in got.collect()} == want


def test_a_text_is_split_once_for_all_its_shingles(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    df = spark.createDataFrame([(i, i, text + f" {i}") for i in range(4)], "msg_id int, day int, text string").coalesce(1)
    began = dt.datetime.now()
    got = {r.msg_id: r.status for r in G.text_novelty(df, "day", 7, 0.5).collect()}
    assert got == {0: "new", 1: "reprint", 2: "reprint", 3: "reprint"} and (dt.datetime.now() - began).total_seconds() < 60


def test_logarithms_of_zero_and_below(spark):
    df = spark.createDataFrame([(0.0,), (-0.5,), (-1.0,), (-2.0,), (None,), (3.0,)], "x double")
    got = [tuple(r) for r in df.select(*T.log_features(["x"]).values()).collect()]
    assert got[0] == (-math.inf, 0.0) and math.isnan(got[1][0]) and abs(got[1][1] - math.log(0.5)) < 1e-12
    assert math.isnan(got[2][0]) and got[2][1] == -math.inf and all(map(math.isnan, got[3])) and got[4] == (None, None) and abs(got[5][0] - math.log(3)) < 1e-12


def test_sessions_a_whole_gap_apart_are_two(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, 0.0), (1, 21600.0), (2, 0.0), (2, 21599.999999), (3, 0.0), (3, 21600.1)]
    df = spark.createDataFrame([(u, start + dt.timedelta(seconds=x)) for u, x in rows], "user_id int, ts timestamp")
    out = L.replay(df, lambda x: L.entity_sessions(x, "user_id", "6 hours", "48 hours"), close="72 hours")
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 1), (2, 2), (3, 1), (3, 1)]


def test_stream_sessions_count_whole_seconds(spark):
    from tidemark.plans import q_streams

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(1, start + dt.timedelta(seconds=0.9)), (1, start + dt.timedelta(seconds=21600.1))], "user_id long, ts timestamp")
    assert sorted((r["first"], r.n) for r in q_streams.l7_stream_sessions(lambda name: df, None).collect()) == [(1704067200, 1), (1704088800, 1)]


def test_joined_views_are_dealt_by_their_rows(spark, monkeypatch):
    from tidemark.plans import catalog, fixtures

    sf = "/root/testdata/sf0.001"
    names = ("v_mention", "d8_unordered_pairs", "h3_windowed_cooccurrence")
    make = lambda name: catalog.QUERIES[name](spark, sf) if name in catalog.QUERIES else fixtures.view(spark, sf, name)
    whole = [sorted(map(tuple, make(name).collect())) for name in names]
    monkeypatch.setattr(fixtures, "ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    assert fixtures.parts(spark, sf, "v_mention") == n > 4 and fixtures.parts(spark, sf, "v_signal") == 0
    p = plan(fixtures.view(spark, sf, "v_mention"))
    assert "REPARTITION_BY_NUM" in p and f", {n})" in p
    assert [sorted(map(tuple, make(name).collect())) for name in names] == whole


def test_the_next_spike_is_looked_up_once_for_each_time(spark, monkeypatch):
    asked, real = [], G.precedes_spike
    monkeypatch.setattr(G, "precedes_spike", lambda events, *a, **b: asked.extend(map(tuple, events.collect())) or real(events, *a, **b))
    m = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (2, 1, "b"), (3, 4, "a"), (3, 4, "a"), (4, 9, "b")], "event_id int, day int, entity string")
    got = G.entities_before_spikes(m, spark.createDataFrame([(3,), (5,)], "day int"), "day", 3)
    assert {r.entity: (r.spikes, r.events, r.mean_ahead) for r in got.collect()} == {"a": (2, 3, 5 / 3), "b": (1, 1, 2.0)}
    assert sorted(asked) == [(1,), (4,), (9,)]


def test_models_aggregate_the_bars_once(spark):
    from tidemark.operators import series as S
    from tidemark.plans import fixtures, q_models

    sf = "/root/testdata/sf0.001"
    bars = fixtures.view(spark, sf, "v_bars")
    asked = []
    d = S.spike_flags(q_models.features(lambda name: asked.append(name) or bars), "y", [1.5], ["cell"])
    assert asked == ["v_bars"] and any("lineitem" in f for f in bars.inputFiles()) and not any("lineitem" in f for f in d.inputFiles())
    got = q_models.cells(lambda name: bars).select("cell", "day", "x", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bars.select("symbol", "day", "volume", "close").collect()))


def test_window_metrics_are_the_same_in_dealt_parts(spark, monkeypatch):
    from tidemark.plans import catalog, fixtures

    names = ("h4_graph_basics", "h5_hub_degrees", "h7_gini", "h12_windowed_modularity", "h13_assortativity", "h15_centralization")
    rows = lambda: {n: sorted(map(tuple, catalog.QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names}
    whole, dealt, real = rows(), [], fixtures.parts
    monkeypatch.setattr(fixtures, "ROWS", 500)
    monkeypatch.setattr(fixtures, "parts", lambda *a: dealt.append(real(*a)) or dealt[-1])
    assert rows() == whole and len(dealt) >= len(names) and min(dealt) > 4
