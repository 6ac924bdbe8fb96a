"""Scoring by a weighted backoff automaton learned from the corpus.

States are the contexts seen in training: the root, every token, and every longer n-gram short of the model's order. A
state has an arc for each token that follows it in training, weighted with its smoothed log10 probability, and a failure
arc to the state of its longest proper suffix, weighted with what is left for tokens that do not follow. Weights are
interpolated with a Dirichlet prior: an arc from context h on w weighs (c(h w) + m p(w | shorter h)) / (c(h) + m), the
failure arc m / (c(h) + m). The root has an arc for every token, by add-``add`` counts. Scoring a text is one traversal
from left to right that carries the state and adds up the weights of the arcs it takes.

The automaton of a whole corpus fits in no single task, so it is met piecewise (see ``exchange``): documents form blocks
of bounded size, a block learns the corpus's counts of its own n-grams from shards, builds the part of the automaton that
its texts can reach, and traverses it. Counts go by order: an n-gram of order 3 or more is asked for only if both its
context and its suffix stand in other blocks too; else the block's own count is the corpus's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.exchange import U64, follow, own_place, pack_keys, pack_numbers, shard_bounds, unpack_keys, unpack_numbers
from tidemark.scratch import materialize

START, END = U64(0x5BD1E9955BD1E995), U64(0xC2B2AE3D27D4EB4F)


class Grams:
    """The n-grams of a block of texts, by order: for each token in turn the number of the n-gram that ends there.

    A text's start is one symbol before it. ``ids[k]`` is -1 where a text has no n-gram of order k yet; ``keys[k]`` are
    the distinct ones, sorted, ``first[k]`` a place of each and ``local[k]`` their counts in the block's training texts.
    """

    def __init__(self, texts: Sequence[pa.Scalar], held_out: np.ndarray, order: int):
        sizes, parts = [], []
        for value in texts:
            words = (value.as_py() or b"").lower().split()  # ASCII white space
            sizes.append(len(words) + 1)
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words)))
            parts.append(np.array([END], dtype=U64))
        self.order, self.sizes = order, np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        word = np.concatenate(parts)
        training = np.repeat(~held_out, self.sizes)
        place = (np.arange(len(word)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.keys, self.ids, self.first, self.local = {}, {}, {}, {}
        key = word
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(key)
                before[1:] = key[:-1]
                if k == 2:
                    before[self.starts] = START
                key = follow(before, word)
            valid = np.flatnonzero(place >= k - 2).astype(np.int32)
            found, first, at = np.unique(key[valid], return_index=True, return_inverse=True)
            ids = np.full(len(word), -1, dtype=np.int32)
            ids[valid] = at
            self.keys[k], self.ids[k], self.first[k] = found, ids, valid[first]
            self.local[k] = np.bincount(at, weights=training[valid], minlength=len(found)).astype(np.int32)

    def context(self, k: int) -> np.ndarray:
        """Number of the context of each distinct n-gram of order ``k``; the start of a text is the number after all tokens."""
        at = self.first[k]
        if k > 2:
            return self.ids[k - 1][at - 1]
        begins = np.isin(at, self.starts)
        return np.where(begins, len(self.keys[1]), self.ids[1][at - 1])

    def suffix(self, k: int) -> np.ndarray:
        return self.ids[k - 1][self.first[k]]

    def asked(self, k: int) -> np.ndarray:
        """Which distinct n-grams of order ``k`` other blocks may have too."""
        if k < 3:
            return np.ones(len(self.keys[k]), dtype=bool)
        return self.shared[k - 1][self.context(k)] & self.shared[k - 1][self.suffix(k)]

    def learn(self, answers: pa.Table, upto: int) -> None:
        """Take the corpus's counts of orders up to ``upto`` from the answers, which come by shard in key order, as
        ``totals``, and as ``shared`` which n-grams stand in other blocks too."""
        answers, self.totals, self.shared = answers.sort_by([("order", "ascending"), ("shard", "ascending")]), {}, {}
        of = np.array(answers.column("order").to_pylist(), dtype=np.int64)
        raw = answers.column("totals").to_pylist()
        for k in range(1, upto + 1):
            asked = self.asked(k)
            told = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(raw[i], "<i8") for i in np.flatnonzero(of == k))])
            self.totals[k], self.shared[k] = self.local[k].astype(np.int64), np.zeros(len(asked), dtype=bool)
            self.totals[k][asked], self.shared[k][asked] = told >> 1, told & 1


class Automaton:
    """The automaton of the n-grams of a block: arcs sorted by (state, token), failure arcs, and the root's arcs by token."""

    def __init__(self, grams: Grams, tokens: int, types: int, add: float, priors: Sequence[float]):
        n, totals = len(grams.keys[1]), grams.totals
        p = (totals[1] + add) / (tokens + add * (types + 1))
        self.order, self.width, self.root = grams.order, n + 1, np.log10(p)
        # states: the root, then tokens with the start of a text as the last, then longer contexts
        count = np.append(totals[1], totals[1][np.searchsorted(grams.keys[1], END)])
        base = {1: 1}
        for k in range(2, grams.order):
            base[k] = base[k - 1] + len(grams.keys[k - 1]) + (k == 2)
        self.root_to = np.where(totals[1] > 0, base[1] + np.arange(n), 0)
        self.start = base[1] + n if count[n] else 0
        keys, weights, to = [], [], []
        self.fail, self.fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        back = np.zeros(n + 1, dtype=np.int64)
        for k in range(2, grams.order + 1):
            m = priors[k - 2]
            self.fail.append(back)
            self.fail_weight.append(np.log10(m / (count + m)))
            context, suffix, c = grams.context(k), grams.suffix(k), totals[k]
            p = (c + m * p[suffix]) / (count[context] + m)
            seen = np.flatnonzero(c)
            arcs = (base[k - 1] + context[seen].astype(np.int64)) * self.width + grams.ids[1][grams.first[k][seen]]
            by = np.argsort(arcs)  # states of higher orders have higher numbers, so the parts follow each other
            seen = seen[by]
            keys.append(arcs[by])
            weights.append(np.log10(p[seen]))
            to.append(base[k] + seen if k < grams.order else base[k - 1] + suffix[seen])
            back, count = base[k - 1] + suffix, c
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(self.fail_weight)
        self.keys, self.weight, self.to = (np.concatenate(x) for x in ([*keys, [np.iinfo(np.int64).max]], weights, to))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and the weights of the arcs taken, for many walks side by side."""
        weight, after, open_ = np.zeros(len(state)), np.empty_like(state), np.arange(len(state))
        while len(open_):
            s, t = state[open_], token[open_]
            at_root = s == 0
            done = open_[at_root]
            weight[done] += self.root[t[at_root]]
            after[done] = self.root_to[t[at_root]]
            open_, s, t = open_[~at_root], s[~at_root], t[~at_root]
            want = s * np.int64(self.width) + t
            at = np.searchsorted(self.keys, want)
            hit = self.keys[at] == want
            weight[open_[hit]] += self.weight[at[hit]]
            after[open_[hit]] = self.to[at[hit]]
            open_, s = open_[~hit], s[~hit]
            weight[open_] += self.fail_weight[s]
            state[open_] = self.fail[s]
        return after, weight

    def score(self, token: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stride: int) -> np.ndarray:
        """log10 probability of each text. Texts, and long ones in stretches of ``stride`` tokens, are walked side by side:
        the state depends on the last ``order`` - 1 tokens, so a stretch reads that many before it to come into its state."""
        of = np.repeat(np.arange(len(sizes)), -(-sizes // stride))
        turn = np.arange(len(of)) - np.repeat(np.cumsum(-(-sizes // stride)) - -(-sizes // stride), -(-sizes // stride))
        begin = starts[of] + turn * stride
        end = np.minimum(begin + stride, starts[of] + sizes[of])
        warm = np.maximum(starts[of], begin - (self.order - 1))
        by = np.argsort(warm - end, kind="stable")
        of, begin, end, warm = of[by], begin[by], end[by], warm[by]
        length = end - warm
        state = np.where(warm == starts[of], self.start, 0)
        total = np.zeros(len(of))
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = warm[:live] + t
            state[:live], weight = self.step(state[:live], token[at])
            total[:live] += np.where(at >= begin[:live], weight, 0.0)
        return np.bincount(of, weights=total, minlength=len(sizes))


_ASK = pa.schema([("order", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASK_SQL = "order int, shard int, block int, keys binary, counts binary"
_ANSWER = pa.schema([("block", pa.int32()), ("order", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
_ANSWER_SQL = "block int, order int, shard int, totals binary, tokens bigint, types bigint"


def _requests(grams: Grams, orders: Sequence[int], block: int, shards: int) -> pa.Table:
    rows = []
    for k in orders:
        mask = grams.asked(k)
        keys, counts = grams.keys[k][mask], grams.local[k][mask]
        bounds = shard_bounds(keys, shards)
        for s in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[s], bounds[s + 1])
            rows.append((k, int(s), block, pack_keys(keys[part]), pack_numbers(counts[part])))
    columns = zip(*rows, strict=True) if rows else ([] for _ in _ASK)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASK, strict=True)], schema=_ASK)


def _ask(shards: int):
    """Requests for the first two orders."""

    def run(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("_text"), table.column("held_out").to_numpy(), 2)
        return _requests(grams, (1, 2), table.column("block")[0].as_py(), shards)

    return run


def _ask_next(shards: int, k: int):
    """Requests for order ``k`` of blocks that know the lower ones."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _ASK.empty_table()
        grams = Grams(docs.column("_text"), docs.column("held_out").to_numpy(), k)
        grams.learn(answers, k - 1)
        return _requests(grams, (k,), docs.column("block")[0].as_py(), shards)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Twice the total, and one more if several blocks asked, in the order of each block's keys; with the first block's
    answer go the shard's tokens and types."""
    asked = [unpack_keys(v.as_py()) for v in table.column("keys")]
    counts = np.concatenate([unpack_numbers(v.as_py()) for v in table.column("counts")]).astype(np.int64)
    found, at = np.unique(np.concatenate(asked), return_inverse=True)
    every = np.zeros(len(found), dtype=np.int64)
    np.add.at(every, at, counts)
    told = every * 2 + (np.bincount(at, minlength=len(found)) > 1)
    parts = np.split(told[at], np.cumsum([len(a) for a in asked])[:-1])
    rest, k = [0] * (table.num_rows - 1), table.column("order")[0].as_py()
    columns = [
        table.column("block").to_pylist(), [k] * table.num_rows, table.column("shard").to_pylist(), [pack_numbers(x, "<i8") for x in parts],
        [int(every.sum()) if k == 1 else 0, *rest], [int((every > 0).sum()) if k == 1 else 0, *rest],
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)


def _traverse(order: int, tokens: int, types: int, add: float, priors: Sequence[float], stride: int, id_type: pa.DataType):
    schema = pa.schema([("_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        grams = Grams(docs.column("_text"), docs.column("held_out").to_numpy(), order)
        grams.learn(answers, order)
        automaton = Automaton(grams, tokens, types, add, priors)
        token = grams.ids[1].astype(np.int64)
        known = np.add.reduceat((grams.totals[1][token] > 0).astype(np.int64), grams.starts)
        base = np.add.reduceat(automaton.root[token], grams.starts)
        score = automaton.score(token, grams.starts, grams.sizes, stride)
        columns = [docs.column("_id").combine_chunks(), docs.column("held_out").combine_chunks(), *map(pa.array, (grams.sizes, known, base, score))]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, priors: Sequence[float] = (300.0, 25.0),
    block_bytes: int = 5 << 20, shard_bytes: int = 10 << 20, least_blocks: int = 24, stride: int = 1024,
) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Training texts are those whose crc32 of the id as text is not 0 modulo 10; all others are held out. Tokens are
    lower-cased (A-Z) runs between ASCII white space and one end. base_score sums log10 of the add-``add`` unigram
    probabilities, score is the automaton's log10 probability; ``priors`` holds the weight m of the prior for each order
    from 2 on, and so the model's order. A null text has the end only; a null id counts as an empty one, which is held
    out; repeated rows count and are scored each for itself; rows that repeat both id and text are dealt to different blocks
    if ``docs`` come from files, else they share one. An empty input gives no rows.
    """
    order = len(priors) + 1
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n_blocks, shards = max(least_blocks, -(-size // block_bytes)), max(1, -(-size // shard_bytes))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("binary").alias("_text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), own_place(docs)), F.lit(n_blocks)).cast("int").alias("block"),
    )

    answered = lambda asked: materialize(asked.groupBy("order", "shard").applyInArrow(_answer, _ANSWER_SQL), "answers")
    answers = answered(rows.groupBy("block").applyInArrow(_ask(shards), _ASK_SQL))
    tokens, types = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    answers = answers.select("block", "order", "shard", "totals")
    for k in range(3, order + 1):
        asked = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_next(shards, k), _ASK_SQL)
        answers = answers.unionByName(answered(asked).select("block", "order", "shard", "totals"))
    kind = docs.schema[id_col].dataType
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _traverse(order, tokens, types, add, priors, stride, to_arrow_type(kind)),
        f"_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
