"""Findings of round 4."""

import random
import uuid

import duckdb

from tidemark import scratch
from tidemark.operators import graph as G
from tidemark.plans import catalog


def test_logs_equal_their_sql_where_values_are_zero(spark, tmp_path):
    name, path = "b15_b16_log_and_effect", str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, range % 7 AS user_id, 'view' AS event_type, range / 100.0::DOUBLE AS value, '{\"k\": ' || range % 100 || '}' AS props FROM range(20000)")
    con.execute(f"COPY events TO '{path}' (FORMAT parquet)")
    got = {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("msg_id", "log_value", "log1p_value", "label").collect()}
    want = con.execute(catalog.ORACLES[name]).fetchall()
    assert (0, float("-inf"), 0.0, "negligible") in got and got == set(want) and len(got) == 20_000


def test_texts_without_a_partner_leave_nothing_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path / uuid.uuid4().hex))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(300)]
    got = G.text_novelty(spark.createDataFrame([(i, i % 9, t) for i, t in enumerate(texts)], "msg_id int, day int, text string"), "day", 7, 0.5)
    assert {r.status for r in got.collect()} == {"new"}
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < sum(map(len, texts)) / 4


def test_novelty_over_many_blocks_and_frequent_texts(spark, monkeypatch):
    from tidemark.operators import shingles

    for name, value in (("BLOCK", 5), ("BLOCKS", 2), ("FREQUENT", 3), ("SETS", 4)):
        monkeypatch.setattr(shingles, name, value)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 40))] for _ in range(15)]
    rows = []
    for i in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, rng.randrange(25), rng.choice((" ", "  ", "\n")).join(rng.choice((w, w.upper())) for w in words)))
    rows += [(240 + i, i, t) for i, t in enumerate([None, None, "", " ", "a a a a", "a a a a a"] + ["one and the same text"] * 90)]
    words = {i: None if t is None else t.lower().split() for i, _, t in rows}
    sets = {i: None if w is None else {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} for i, w in words.items()}
    got = {r.msg_id: r for r in G.text_novelty(spark.createDataFrame(rows, "msg_id int, day int, text string"), "day", 7, 0.5).collect()}
    assert len(got) == len(rows)
    for i, day, _ in rows:
        near = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j, d, _ in rows if 1 <= day - d <= 7 and sets[i] is not None and sets[j] is not None]
        s = max(near, default=0.0)
        assert got[i].status == ("reprint" if s >= 0.95 else "update" if s >= 0.5 else "new") and abs(got[i].likeness - (s if s >= 0.5 else 0.0)) < 1e-12


def test_copies_travel_once_for_each_group_of_pairs(spark, monkeypatch):
    from tidemark.operators import shingles

    met, real = [], shingles.materialize
    monkeypatch.setattr(shingles, "materialize", lambda df, name: met.append(real(df, name)) or met[-1])
    words = [f"w{i}" for i in range(100)]
    rows = [(i, i % 5, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(60)]
    got = G.text_novelty(spark.createDataFrame(rows, "msg_id int, day int, text string"), "day", 7, 0.5)
    assert {r.msg_id % 5: r.status for r in got.collect()} == {0: "new", 1: "update", 2: "update", 3: "update", 4: "update"}
    (pairs,) = [df for df in met if "meet" in df.columns]
    sent = pairs.selectExpr("meet", "explode(array(h, p)) AS h").distinct().count()
    assert pairs.count() > 1000 and sent < 400  # two for each pair before
