"""Alias automaton, leave-one-out moments, coverage, sketches, late rows, table function, sliding sums: against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import buckets as B
from tidemark.operators import dedup as C
from tidemark.operators import graph as G
from tidemark.operators import joins as D
from tidemark.operators import model as M
from tidemark.operators import series as S
from tidemark.operators import stats as I
from tidemark.streaming import streams as L


def test_alias_automaton_equals_plain_search(spark):
    rng = random.Random(1)
    aliases = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 4)))) for i in range(10_000)] + [(10_000, "")]
    names = [None, "", "ABCA", *("".join(rng.choice("abc ") for _ in range(12)) for _ in range(40))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    for whole in (False, True):
        pad = " " if whole else ""
        got = {r.id: r.hits for r in C.alias_hits(df, "name", aliases, whole).collect()}
        for i, n in enumerate(names):
            assert got[i] == [k for k, a in aliases if pad + a + pad in pad + (n or "").lower() + pad]
    assert C.alias_hits(df, "name", []).where(F.size("hits") > 0).count() == 0
    with pytest.raises(ValueError):
        C.alias_hits(df, "name", [(0, "a")] * (C.MOST_ALIASES + 1))


def test_targets_by_ticker_and_alias(spark):
    t = "array<struct<name:string,ticker:string,sentiment:int,impact:int,category:string>>"
    msgs = spark.createDataFrame([(1, [("Ether chain", None, 1, 3, "A"), ("x", "eth", -1, 3, "B"), ("Bit", "", 1, None, None)]), (2, [(None, None, 1, 1, "A")]), (3, None)], f"msg_id int, targets {t}")
    assets = spark.createDataFrame([("E", ["ETH"], ["ether"]), ("B", None, ["bit", None]), ("N", [""], None)], "asset string, tickers array<string>, aliases array<string>")
    got = {(r.asset, r.msg_id): (r.pos, r.sentiment, r.impact, r.category) for r in C.select_asset_target(msgs, assets).collect()}
    assert got == {("E", 1): (0, 1, 3, "A"), ("B", 1): (2, 1, 1, "UNKNOWN"), ("N", 1): (0, 1, 3, "A"), ("N", 2): (0, 1, 1, "A")}


def test_each_source_left_out(spark):
    rng = np.random.default_rng(5)
    rows = [("c", s, 1e6 + float(v), 3.0 * k + float(w)) for k, (s, n) in enumerate((("a", 40), ("b", 25), ("d", 1))) for v, w in rng.normal(size=(n, 2))] + [("one", "a", 1.0, 2.0), ("flat", "a", 1.0, 2.0), ("flat", "b", 1.0, 5.0), ("flat", "b", 1.0, 6.0), ("c", "a", None, 1.0)]
    got = {(r.cell, r.source): r for r in I.without_each_source(spark.createDataFrame(rows, "cell string, source string, x double, y double"), ["cell"], "source").collect()}
    for s in "abd":
        x, y = np.array([r[2:] for r in rows if r[0] == "c" and r[1] != s and r[2] is not None]).T
        assert got["c", s].n == len(x) and got["c", s].dominant == (s == "a")
        assert abs(got["c", s].r - np.corrcoef(x, y)[0, 1]) < 1e-6 and abs(got["c", s].slope - np.polyfit(x - x.mean(), y, 1)[0]) < 1e-6
    assert got["one", "a"].n == 0 and got["one", "a"].r is None and got["one", "a"].share == 1
    assert got["flat", "a"].slope is None and got["flat", "b"].dominant


def test_hours_are_told_apart(spark):
    grid = spark.createDataFrame([("k", h, h in (0, 5)) for h in range(10)], "key string, hr long, observed boolean")
    collected = spark.createDataFrame([("k", "s", t) for t in (0, 3600, 7300, 7300, 18000)] + [("k", "z", 25300)], "key string, source string, t long")
    intervals = S.coverage_intervals(collected, ["key", "source"], "t", 4000)
    assert sorted((r.first, r.last) for r in intervals.collect()) == [(0, 7300), (18000, 18000), (25300, 25300)]
    states = [r.state for r in S.hour_states(grid, intervals, ["key"], "hr").orderBy("hr").collect()]
    assert states == ["observed", "empty", "empty", "uncovered", "uncovered", "observed", "uncovered", "empty", "uncovered", "uncovered"]


def test_sketches_roll_up_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.xxhash64(F.col("id") % 20_000).alias("user"), (F.col("id") % 7).alias("few"))
    daily = B.distinct_sketches(df, ["day"], ["user", "few"])
    assert daily.count() == 30
    week = {r.window: r for r in B.roll_up_distinct(daily, F.floor(F.col("day") / 7)).collect()}
    exact = {r.w: r for r in df.groupBy(F.floor(F.col("day") / 7).alias("w")).agg(F.countDistinct("user").alias("user"), F.countDistinct("few").alias("few")).collect()}
    for w, r in week.items():
        assert r.few == exact[w].few and abs(r.user / exact[w].user - 1) < 0.05


def test_late_rows_over_more_batches_than_are_recorded(spark, tmp_path):
    rng = random.Random(2)
    times = [1_700_000_000 + 600 * b + rng.choice([0, 0, -4000, -20_000]) for b in range(9) for _ in range(20)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "s long, i int").select(F.timestamp_seconds("s").alias("ts"), "i", F.lit("a").alias("asset"), F.lit(1.0).alias("sentiment"), F.lit(1.0).alias("impact"))
    rows = df.collect()
    for b in range(9):
        spark.createDataFrame(rows[20 * b : 20 * b + 20], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    L.late_rows_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state").start().awaitTermination()
    want, mark = set(), None
    for b in range(9):
        own = times[20 * b : 20 * b + 20]
        want |= {20 * b + k for k, t in enumerate(own) if mark is not None and t < mark}
        mark = max([*own, (mark or 0) + 7200]) - 7200
    late = L.read_split(spark, f"{tmp_path}/out", df.schema)
    assert {r.i for r in late.collect()} == want and len(want) > 20
    assert late.agg(F.max("batch")).first()[0] == 8
    assert L.read_split(spark, f"{tmp_path}/out", df.schema, False).count() == 180 - len(want)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 3)
    groups = L.LateGroups()
    spark.streams.addListener(groups)
    query = L.tumbling_sentiment(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert groups.total(query) > 0
    spark.streams.removeListener(groups)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    with pytest.raises(ValueError):
        L.dropped_late(query)


def test_pairs_by_table_function(spark):
    G.register_table_functions(spark)
    rows = [(e, n) for e, names in ((1, "cab"), (2, "a"), (3, "bab"), (4, "")) for n in names] + [(1, None)]
    spark.createDataFrame(rows, "event int, entity string").createOrReplaceTempView("some_mentions")
    got = sorted(map(tuple, spark.sql("SELECT src, dst FROM entity_pairs(TABLE(some_mentions) PARTITION BY event)").collect()))
    listed = spark.sql("SELECT event, array_sort(collect_set(entity)) AS names FROM some_mentions GROUP BY event")
    assert got == sorted(map(tuple, listed.select(F.explode(G.pairs_of("names")).alias("p")).select("p.*").collect())) == [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")]


@pytest.mark.parametrize("closed", ["both", "left", "right"])
def test_sliding_sums_equal_copies(spark, closed):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randint(-50, 400), rng.randint(1, 9)) for _ in range(80)] + [("a", 100, None)], "k string, t long, v long")
    copies = D.sliding_assign(df, "t", 60, 10, closed).groupBy("k", "window_end").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("v", F.lit(0))).alias("s"))
    cols = ["k", "window_end", "n", "s"]
    assert sorted(D.sliding_sums(df, "t", 60, 10, {"s": F.col("v")}, closed, ["k"]).select(cols).collect()) == sorted(copies.select(cols).collect())


def test_next_spike_of_each_key(spark):
    rng = random.Random(7)
    events = [(rng.choice("ab"), rng.randint(0, 300), i) for i in range(200)]
    spikes = sorted({(rng.choice("ab"), rng.randint(0, 300)) for _ in range(25)})
    e, s = spark.createDataFrame(events, "k string, t long, i int"), spark.createDataFrame(spikes, "k string, t long")
    want = {(i, n[0] - t) for k, t, i in events if (n := [x for y, x in spikes if y == k and t < x <= t + 20][:1])}
    for least in (1_000_000, 20):
        assert {(r.i, r.ahead) for r in G.precedes_spike(e, s, "t", 20, ["k"], least).collect()} == want


def test_spikes_of_the_whole_market_and_labels(spark):
    df = spark.createDataFrame([("a", float(i % 3)) for i in range(30)] + [("b", 100.0)], "k string, v double")
    assert [r.k for r in S.spike_flags(df, "v", [2], []).where("spike_2").collect()] == ["b"]
    got = spark.createDataFrame([(0.6, 0.01), (-0.31, 0.05), (0.3, None)], "r double, p double").select(X.strength_label("r"), X.significant("p")).collect()
    assert [tuple(r) for r in got] == [("Strong", True), ("Moderate", False), ("Weak", False)]


def test_ranked_features_carry_the_discovery_rate(spark):
    cells = spark.createDataFrame([("t", f"f{i}", 50, r, p) for i, (r, p) in enumerate([(0.9, 0.001), (-0.95, 0.0001), (0.2, 0.04), (0.1, 0.6)])], "target string, feature string, n long, r double, p double")
    got = {r.feature: (r["rank"], round(r.q, 6), r.significant) for r in M.ranked_features(cells).collect()}
    assert got == {"f1": (1, 0.0004, True), "f0": (2, 0.002, True), "f2": (3, 0.053333, False), "f3": (4, 0.6, False)}
