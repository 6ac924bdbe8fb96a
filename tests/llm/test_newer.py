"""Conversation repair, whitening and line deduplication against SQL, brute force and numpy, with awkward rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C
from tidemark.llm import line_dedup, registry
from tidemark.llm import whitening as W

SF = "/root/testdata/sf0.001"
BLANK = "\x20\t\n\x0b\x0c\r"


def sql(name, table, path=None, frame=None):
    con = duckdb.connect()
    if frame is not None:
        con.register(table, frame)
    else:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con.execute(registry.ORACLES[name]).df()


def same(got, want):
    key = lambda row: tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) else str(v) for v in row)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(key, got[cols].astype(object).values.tolist())) == sorted(map(key, want[cols].astype(object).values.tolist()))


# 11


def least(rows):
    """Cheapest and then least edits of (initial, must go, cut), by trying all, with at most two insertions at a place."""
    found = []
    for letters in itertools.product("DKR", repeat=len(rows)):
        for puts in itertools.product(range(3), repeat=len(rows) + 1):
            cost, initials, audit = 5 * sum(puts), [], ""
            ok = True
            for k, (letter, (c, gone, cut)) in enumerate(zip(letters, rows, strict=True)):
                ok &= letter == "D" or not gone
                audit += "I" * puts[k] + letter
                initials += ["*"] * puts[k] + ([] if letter == "D" else [c if letter == "K" else "*"])
                cost += {"D": 2, "K": 0, "R": 1}[letter] + (5 if cut and letter != "D" else 0)
            initials += ["*"] * puts[-1]
            if ok:
                found.append((cost, audit + "I" * puts[-1], initials))
    found.sort(key=lambda f: f[:2])
    for cost, audit, initials in found:
        for wanted in ("", *(s + "ua" * k for s in ("", "s") for k in range(1, len(initials) // 2 + 1))):
            if len(wanted) == len(initials) and all(a == b or (a == "*" and b != "s") for a, b in zip(initials, wanted, strict=True)):
                return cost, audit


def test_edits_equal_exhaustive_search():
    rng = random.Random(3)
    for _ in range(120):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        codes = bytes(C._CODE.get(c.encode(), 0) | (C._MUST_GO if gone else C._CUT if cut else 0) for c, gone, cut in rows)
        v, total = C.costs(codes)
        steps = list(C.walk(codes))
        audit = "".join(s[0] for s in steps) + C.last_edits(steps[-1][1] if steps else 0)[0]
        assert (v[0] + total, audit) == least(rows)


def test_checkpoints_do_not_change_the_walk():
    codes = bytes(random.Random(1).choice((0, 1, 2, 3, 5, 6, 7, 10, 11)) for _ in range(500))
    v, ahead = [C.END], None
    for code in reversed(codes):
        v.append(C._back(code, v[-1])[0])
    state, want = 0, []
    for code, ahead in zip(codes, reversed(v[:-1]), strict=True):
        letters, state = C._forward(code, ahead, state)
        want.append((letters, state))
    assert list(C.walk(codes)) == want


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", "tool", None, "ünder"]), rng.choice(["Yes.", "no", "", None, " \t", "a b!", "日本。", "x?\n"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "null turn."), (7, None, "user", "null turn."), (7, 3, "user", "tie."), (7, 3, "user", "tie."), (None, 1, "user", "no id."), (None, None, None, None)]
    rows += [(99, i // 3, ("user", "assistant")[i % 2], f"text {i % 40}.") for i in range(300)]
    rows += [(100, None, "user", "all equal.")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(1) for c in ("conv", "copies", "kind", "run", "_long", "size", "mark", "state")})


def test_repair_equals_sql(spark, talks):
    same(registry.QUERIES["op11_conversation_repair"](spark, SF).toPandas(), sql("op11_conversation_repair", "conversations", SF))
    rows, copies = C.damage(talks)
    same(C.repair_conversations(rows, copies=copies).toPandas(), sql("op11_conversation_repair", "conversations", frame=talks.select("conv_id", "turn", "role", "text").toArrow()))


def test_long_conversations_are_cut(spark, talks, monkeypatch):
    rows, copies = C.damage(talks)
    want = C.repair_conversations(rows, copies=copies).toPandas()
    cut = []
    plain = C._repair_long
    monkeypatch.setattr(C, "_repair_long", lambda rows, chunk: cut.append(rows.select("conv").distinct().count()) or plain(rows, chunk))
    for bytes_, n in ((2000, 4), (1, 40)):
        monkeypatch.setattr(C, "shuffle_partitions", lambda s, n=n: n)
        same(C.repair_conversations(rows, copies=copies, least_long=bytes_, chunk=300).toPandas(), want)
    assert cut[0] >= 1 and cut[1] > 10


def test_no_conversations(spark, talks):
    assert C.repair_conversations(talks.where("false")).collect() == []
    gone = C.repair_conversations(talks.where("conv_id < 2"), copies=F.lit(0)).collect()
    assert [tuple(r)[1:] for r in gone] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


# 12


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), centred @ vector / np.sqrt(value), value / (centred**2).sum() * n


def test_whitening_equals_eigenvectors(spark):
    got = registry.QUERIES["op12_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    deviation, white, explained = plain_whitening(given["embedding"].tolist(), 8)
    assert (got["deviation"].to_numpy().reshape(-1, 8) == deviation[:, None]).all() and (got["n"] == len(given)).all()
    seen = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(seen * np.sign((seen * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:8] - explained).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


def test_whitening_of_badly_conditioned_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6)) * [1e5, 1e3, 10, 1, 0.1, 0.01]
    rows = np.hstack([base @ rng.normal(size=(6, 6)), np.full((400, 1), 2.5), base[:, :1]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    fit = W.fit_whitening(df, components=6)
    value = np.linalg.svd((x := np.floor(1024 * rows)) - x.mean(axis=0), compute_uv=False)[:6] ** 2 / 400
    assert np.abs(fit.values / value - 1).max() < 1e-6 and fit.identity_error < 1e-4


def test_whitening_of_awkward_rows(spark):
    odd = [(None, [1.0, 2.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("-inf"), 1.0]), (9, [1.0]), (10, []), (11, [1.0] * 3)]
    whole = [(i, [float(i % 3), float(i % 5)]) for i in (1, 1, 2, 3, 4)]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("v", "n", "k", "component", "count", "dim")})
    df = make(odd + whole)
    got = W.whiten(df, W.fit_whitening(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i in (None, 1, 1, 2, 3, 4) for c in (1, 2))
    deviation, white, _ = plain_whitening([v for _, v in [(None, [1.0, 2.0]), *whole]], 2)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(abs(white[:, 0])))
    for rows, n in (([], 0), ([(1, None)], 0), ([(1, [3.0, 4.0])] * 3, 6), ([(1, [1e30, 1.0]), (2, [0.0, 1.0])], 4)):
        df = make(rows)
        seen = W.whiten(df, W.fit_whitening(df)).collect()
        assert len(seen) == n and all(r.whitened is None or abs(abs(r.whitened) - 1) < 1e-9 for r in seen)
    assert len([r for r in seen if r.whitened is None]) == 2  # the second dimension does not vary


# 13


def plain_line_dedup(texts, at_least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANK).translate(low)
    count = {}
    for t in texts:
        for k in {key(line) for line in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not key(line) or count[key(line)] < at_least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(9)
    pool = ["Home", " home\t", "HOME\x0b", "É", "é", "", "  ", " home", "a\rb", "menu | about", *(f"line {i}" for i in range(30))]
    texts = [None, "", "\n\n", "Home", *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)), "\n".join(f"l{i % 5000}" for i in range(20000)), *["same text\nHome"] * 12]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "Home\nrepeated row")] * 15
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("a", "b", "d", "t", "docs", "_drop", "_t", "kept")})


@pytest.mark.parametrize(("at_least", "batches", "fanout"), [(1, 1, 2), (3, 5, 2), (10, 4, 3), (10, 7, 2), (500, 2, 3)])
def test_lines_equal_plain_count(spark, lines, at_least, batches, fanout):
    given = lines.select("doc_id", "text").collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept.decode()) for r in line_dedup.line_dedup(lines, at_least, batches, fanout).collect())
    want = plain_line_dedup([r.text for r in given], at_least)
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, *w) for r, w in zip(given, want, strict=True))


def test_lines_equal_sql(spark, lines):
    same(registry.QUERIES["op13_line_dedup"](spark, SF).toPandas(), sql("op13_line_dedup", "documents", SF))
    assert line_dedup.line_dedup(lines.where("false")).collect() == []


def test_runs_are_levelled_and_outlive_their_object(spark, tmp_path):
    docs = lambda k: spark.createDataFrame([(i, f"all\nbatch {k}\nonly {k} {i}") for i in range(3)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), 4, min_docs=5, fanout=2)
    assert runs.frequent().count() == 0
    for k in range(7):
        runs.add(docs(k))
    assert sorted(level for _, level in runs.live()) == [0, 1, 2]
    again = line_dedup.LineRuns(spark, str(tmp_path / "runs"), 4, min_docs=5, fanout=2)
    assert again.live() == runs.live() and again.frequent().count() == 1
    top = next(run for run, level in again.live() if level == 2)
    last = next(run for run, level in again.live() if level == 0)
    assert again.rows(top).where("docs >= 5").count() == 1 and again.rows(last).count() == 4  # the settled line is not counted again
    plan = again.rows(last).join(again.rows(top).hint("merge"), ["a", "b"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again.close()
    assert not [t for t in spark.catalog.listTables() if re.match("line_run_", t.name)]
