"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts character n-grams of trusted documents. Counts, continuation counts, discounts and context statistics are
aggregates over tables sharded by n-gram, and each order's probabilities come from joining its counts with its contexts
and with the next lower order. The model stays a sharded table. Documents form blocks of bounded size; a block joins its
distinct n-grams with the shards (see ``exchange``) and turns the answers into the perplexity of its documents, read
whole. A document is rejected where its perplexity exceeds a high quantile over the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.exchange import U64, follow, mix, own_place, pack_keys, pack_numbers, shard_bounds, unpack_keys, unpack_numbers
from tidemark.scratch import materialize

ORDER = 5
#: Symbol before and after a text; no code point has this number.
EDGE = 0xFFFFFFFF


def stretches(texts: Sequence[pa.Scalar], order: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of the texts, about ``most`` at a time, and for each symbol the text it is predicted for, -1 if for none.

    A text has order - 1 edges before it and one after it. A long text is cut; its parts repeat the order - 1 symbols
    before them as context.
    """
    held, owners, n = [], [], 0
    for i, value in enumerate(texts):
        points = np.frombuffer((value.as_py() or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.full(len(points) + order, EDGE, dtype=np.uint32)
        codes[order - 1 : -1] = points
        for at in range(order - 1, len(codes), most):
            part = codes[at - order + 1 : at + most]
            of = np.full(len(part), i, dtype=np.int64)
            of[: order - 1] = -1
            held.append(part)
            owners.append(of)
            n += len(part)
            if n >= most:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def gram_keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """64-bit keys of all n-grams of order 1 to ``order``: the i-th of order k has the symbols from the i-th on."""
    symbol = codes.astype(U64)
    keys = [mix(symbol + U64(0x2545F4914F6CDD1D))]
    for k in range(1, order):
        keys.append(follow(keys[-1][:-1], symbol[k:]))
    return keys


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once. A plain sort of numbers is several times faster than the argsort behind numpy's index forms."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Stretch:
    """The distinct n-grams of the highest order in a stretch, as they come, with the keys of all their suffixes and contexts."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, order: int):
        keys = gram_keys(codes, order)
        at = np.flatnonzero(owner[order - 1 :] >= 0).astype(np.int32)
        self.owner = owner[order - 1 :][at]
        found = pa.array(keys[-1][at]).dictionary_encode()  # by hash, without a sort
        self.of = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), dtype=np.int64)
        first[self.of[::-1]] = np.arange(len(at) - 1, -1, -1)  # the last write is the first place
        self.place = at[first]
        self.suffixes = [key[self.place + (order - 1 - k)] for k, key in enumerate(keys)]
        # the context of a suffix of k + 1 symbols is the n-gram of k symbols that ends one place before
        self.contexts = [key[self.place + (order - 2 - k)] for k, key in enumerate(keys[:-1])]


class Model:
    """Part of the model that a block has asked for: log10 probabilities and backoff weights by sorted key; NaN where unseen.

    What n-grams of the highest order come to is remembered for the block's next stretches, for about ``most`` of them; others
    are worked out each time."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray, back: np.ndarray, unseen: float, most: int = 2_000_000):
        nan = np.float32(np.nan)
        self.keys, self.log_p, self.back, self.unseen = np.append(keys, U64(2**64 - 1)), np.append(log_p, nan), np.append(back, nan), unseen
        self.most, self.known, self.sums, self.fresh = most, np.zeros(0, U64), np.zeros(0), []

    def look_up(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, values[at], np.float32(np.nan))

    def score(self, stretch: Stretch) -> np.ndarray:
        """log10 probability of each predicted symbol of the stretch."""
        top, total = stretch.suffixes[-1], np.zeros(len(stretch.place))
        hit = np.zeros(len(top), dtype=bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
            hit = self.known[at] == top
            total[hit] = self.sums[at[hit]]
        new = np.flatnonzero(~hit)
        total[new] = self.work_out(stretch, new)
        self.remember(top[new], total[new])
        return total[stretch.of]

    def remember(self, keys: np.ndarray, sums: np.ndarray) -> None:
        if len(self.known) < self.most:
            self.fresh.append((keys, sums))
            if 4 * sum(len(k) for k, _ in self.fresh) > len(self.known):  # few merges, each of many
                keys, sums = (np.concatenate(x) for x in zip((self.known, self.sums), *self.fresh, strict=True))
                self.known, first = np.unique(keys, return_index=True)
                self.sums, self.fresh = sums[first], []

    def work_out(self, stretch: Stretch, which: np.ndarray) -> np.ndarray:
        """Sums of the stretch's distinct n-grams at the places ``which``: the longest known suffix, and the backoffs above it."""
        order, total, open_ = len(stretch.suffixes), np.zeros(len(stretch.place)), which
        for k in range(order - 1, -1, -1):
            p = self.look_up(stretch.suffixes[k][open_], self.log_p)
            seen = ~np.isnan(p)
            total[open_[seen]] += p[seen]
            open_ = open_[~seen]
            if k:
                b = self.look_up(stretch.contexts[k - 1][open_], self.back)
                total[open_] += np.where(np.isnan(b), 0.0, b)
        total[open_] += self.unseen
        return total[which]


def trusted_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, sample_chars: int) -> DataFrame:
    """Texts of trusted documents, about ``sample_chars`` characters of each language, chosen by a hash of the id."""
    trusted = labels.where("quality = 1").select(F.col(id_col).alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(trusted, "_id")
    sizes = texts.groupBy("_lang").agg(F.sum(F.length("_text")).alias("_n"))  # a row for each language
    drawn = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < F.lit((1 << 30) * float(sample_chars)) / F.greatest("_n", F.lit(1))
    return materialize(texts.join(F.broadcast(sizes.withColumnRenamed("_lang", "_l")), F.col("_lang").eqNullSafe(F.col("_l"))).where(drawn).select("_text"), "trusted")


def train(texts: DataFrame, order: int = ORDER, stretch: int = 500_000) -> tuple[DataFrame, float] | None:
    """Model of the column _text as rows (gram, log_p, back), gram being the code points as 32-bit numbers, and the log10
    probability of a symbol never seen; None without any text. Any alphabet will do; the tables grow with the text."""
    if texts.isEmpty():
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, owner in stretches(batch.column(0), order, stretch):
                found = Stretch(codes, owner, order)
                grams = np.lib.stride_tricks.sliding_window_view(codes, order)[found.place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(np.bincount(found.of, minlength=len(found.place)), pa.int64())], names=["g", "c"]
                )

    last = lambda k: F.substring("g", -4 * k, 4 * k)
    counts = {order: materialize(texts.mapInArrow(count, "g binary, c bigint").groupBy("g").agg(F.sum("c").alias("c")), "grams")}
    for k in range(order - 1, 0, -1):  # in how many different places a shorter n-gram continues one
        counts[k] = materialize(counts[k + 1].groupBy(last(k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"counts{k}")
    symbols = counts[1].count() + 1  # and the one never seen

    lower: DataFrame | None = None
    grams, contexts, unseen = [], [], 0.0
    for k in range(1, order + 1):
        table = counts[k].withColumn("ctx", F.substring("g", 1, 4 * (k - 1)) if k > 1 else F.lit(b""))
        n1, n2, n3, n4 = (max(1, x or 0) for x in table.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(0.0, i - (i + 1) * y * b / a), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = table.groupBy("ctx").agg(F.sum("c").alias("t"), F.sum(cut).alias("held"))
        left = F.log10(F.greatest(F.col("held") / F.col("t"), F.lit(1e-12)))
        below = F.lit(1.0 / symbols)
        if k == 1:
            t, held, back = context.select("t", "held", left).first()  # the empty context
            unseen = back - float(np.log10(symbols))
            joined = table.withColumns({"t": F.lit(t), "held": F.lit(held)})
        else:
            contexts.append(context.select(F.col("ctx").alias("gram"), left.alias("back")))
            joined = table.join(context, "ctx").join(lower.select(F.col("gram").alias("_lower"), F.col("p").alias("_p")), last(k - 1) == F.col("_lower"))
            below = F.col("_p")
        p = (F.greatest(F.col("c") - cut, F.lit(0.0)) + F.col("held") * below) / F.col("t")
        lower = materialize(joined.select(F.col("g").alias("gram"), p.alias("p")), f"order{k}")
        grams.append(lower.select("gram", F.log10("p").alias("log_p")))
    none = F.lit(None).cast("double")
    rows = [g.withColumn("back", none) for g in grams] + [c.select("gram", none.alias("log_p"), "back") for c in contexts]
    found = rows[0]
    for part in rows[1:]:
        found = found.unionByName(part)
    return materialize(found.groupBy("gram").agg(F.max("log_p").alias("log_p"), F.max("back").alias("back")), "model"), unseen


def _ask(order: int, stretch: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        keys = block_keys(table.column("_text"), order, stretch)
        bounds, block = shard_bounds(keys, shards), table.column("block")[0].as_py()
        cells = np.flatnonzero(np.diff(bounds))
        columns = [cells.tolist(), [block] * len(cells), [pack_keys(keys[bounds[s] : bounds[s + 1]]) for s in cells]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def block_keys(texts: Sequence[pa.Scalar], order: int, stretch: int) -> np.ndarray:
    """Distinct keys of all n-grams and contexts of a block's texts."""
    found, held = np.zeros(0, U64), []
    for codes, owner in stretches(texts, order, stretch):
        part = Stretch(codes, owner, order)
        held += [distinct(k) for k in (*part.suffixes, *part.contexts)]
        if sum(map(len, held)) > 8 * stretch:
            found, held = distinct(np.concatenate([found, *held])), []
    return distinct(np.concatenate([found, *held]))


def _keyed(shards: int, order: int):
    """Model rows with the key of each n-gram and the shard it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=U64)
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(g) // 4 for g in raw])
            for k in range(1, order + 1):
                at = np.flatnonzero(sizes == k)
                if len(at):
                    flat = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.uint32).reshape(-1, k).astype(U64)
                    key = mix(flat[:, 0] + U64(0x2545F4914F6CDD1D))
                    for j in range(1, k):
                        key = follow(key, flat[:, j])
                    keys[at] = key
            shard = ((keys >> U64(32)) * U64(shards)) >> U64(32)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(keys.view(np.int64)), batch.column(1), batch.column(2)], names=["shard", "key", "log_p", "back"])

    return run


_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("log_p", pa.binary()), ("back", pa.binary())])


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Those of each block's keys that the shard knows, with what it knows of them."""
    if not asked.num_rows:
        return _ANSWER.empty_table()
    key = model.column("key").to_numpy().view(U64)
    order = np.argsort(key)
    key = np.append(key[order], U64(2**64 - 1))
    values = [model.column(c).to_numpy()[order].astype(np.float32) for c in ("log_p", "back")]
    out: list[list] = [[], [], []]
    for raw in asked.column("keys"):
        keys = unpack_keys(raw.as_py())
        at = np.searchsorted(key, keys)
        hit = key[at] == keys
        out[0].append(pack_keys(keys[hit]))
        for column, value in zip(out[1:], values, strict=True):
            column.append(pack_numbers(value[at[hit]], "<f4"))
    return pa.Table.from_arrays([asked.column("block").combine_chunks(), asked.column("shard").combine_chunks(), *(pa.array(c, pa.binary()) for c in out)], schema=_ANSWER)


def _perplexity(order: int, stretch: int, unseen: float, schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        texts, answers = docs.column("_text"), answers.sort_by("shard")
        keys = np.concatenate([np.zeros(0, U64), *(unpack_keys(v.as_py()) for v in answers.column("keys"))])
        p, back = (np.concatenate([np.zeros(0, np.float32), *(unpack_numbers(v.as_py(), "<f4") for v in answers.column(c))]) for c in ("log_p", "back"))
        model = Model(keys, p, back, unseen)
        total, n = np.zeros(docs.num_rows), np.zeros(docs.num_rows, dtype=np.int64)
        for codes, owner in stretches(texts, order, stretch):
            part = Stretch(codes, owner, order)
            total += np.bincount(part.owner, weights=model.score(part), minlength=docs.num_rows)
            n += np.bincount(part.owner, minlength=docs.num_rows)
        columns = [docs.column(f.name).combine_chunks() for f in list(schema)[:-2]]
        return pa.Table.from_arrays([*columns, pa.array(n), pa.array(10.0 ** (-total / n))], schema=schema)

    return run


def score(
    docs: DataFrame, model: tuple[DataFrame, float], id_col: str, text_col: str, carry: list[Column], order: int = ORDER,
    block_bytes: int = 48 << 20, least_blocks: int = 12, stretch: int = 500_000,
) -> DataFrame:
    """The ``carry`` columns, n_symbols and perplexity of each row's whole text. Texts are shuffled once: the blocks that
    ask and the blocks that score are the same exchange."""
    table, unseen = model
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(least_blocks, -(-size // block_bytes))  # shards hold a block's worth of requests each
    text = F.coalesce(F.col(text_col), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(id_col), text, own_place(docs)), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(text.alias("_text"), block, *carry)
    kept = [f for f in rows.schema if f.name not in ("_text", "block")]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kept), ("n_symbols", pa.int64()), ("perplexity", pa.float64())])
    asked = rows.groupBy("block").applyInArrow(_ask(order, stretch, blocks), "shard int, block int, keys binary")
    sharded = table.mapInArrow(_keyed(blocks, order), "shard int, key bigint, log_p double, back double")
    answers = asked.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(_answer, "block int, shard int, keys binary, log_p binary, back binary")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _perplexity(order, stretch, unseen, schema), f"{kinds}, n_symbols bigint, perplexity double"
    )


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.995, sample_chars: int = 4_000_000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
) -> DataFrame:
    """Verdict on each row: _row (a hash of id and text), ``id_col``, lang, n_symbols, perplexity, threshold, kept.

    The model learns from about ``sample_chars`` characters of each language's documents whose label has quality 1;
    thresholds are the ``quantile`` of the perplexity over all of those documents, by language, and within a language
    by length in powers of four, as short texts vary more, where a length has as many trusted documents as tell that
    quantile from the maximum (1 / (1 - ``quantile``)). A language without trusted documents takes the quantile of all.
    Rows at the threshold are kept. A null text counts as empty; null languages form a language of their own; a
    document is trusted if any of its labels says so; characters the model never saw share one probability. Without
    trusted text every row is kept, with null perplexity and threshold. An empty input gives no rows.
    """
    model = train(trusted_sample(docs, labels, id_col, text_col, lang_col, sample_chars), order)
    text = F.coalesce(F.col(text_col), F.lit(""))
    carry = [F.xxhash64(F.col(id_col), text).alias("_row"), F.col(id_col).alias("_id"), F.col(lang_col).alias("lang")]
    if model is None:
        none = F.lit(None).cast("double")
        scored = docs.select(*carry, (F.length(text) + 1).cast("bigint").alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"))
    else:
        scored = materialize(score(docs, model, id_col, text_col, carry, order), "perplexity").withColumn("_band", F.floor(F.log2("n_symbols") / 2).cast("int"))
        trusted = scored.join(labels.where("quality = 1").select(F.col(id_col).alias("_id")).distinct(), "_id")
        cells = trusted.groupingSets([["lang", "_band"], ["lang"], []], "lang", "_band").agg(
            F.grouping_id().alias("level"), F.percentile_approx("perplexity", quantile, 10_000).alias("q"), F.count(F.lit(1)).alias("n")
        )
        cells = materialize(cells, "thresholds")  # a few rows for each language
        over_all = cells.where("level = 3").first()["q"]
        pick = lambda level, name: cells.where(F.col("level") == level).select(F.col("lang").alias(f"_l{level}"), F.col("_band").alias(f"_b{level}"), F.col("q").alias(name), F.col("n").alias(f"_n{level}"))
        same = lambda level: F.col("lang").eqNullSafe(F.col(f"_l{level}"))
        by = scored.join(F.broadcast(pick(0, "_q0")), same(0) & (F.col("_band") == F.col("_b0")), "left").join(F.broadcast(pick(1, "_q1")), same(1), "left")
        enough = F.col("_n0") * (1 - quantile) >= 1 - 1e-9
        scored = by.withColumn("threshold", F.coalesce(F.when(enough, F.col("_q0")), "_q1", F.lit(over_all)))
    return scored.select(
        "_row", F.col("_id").alias(id_col), "lang", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns."""
    kept = classify(docs, labels, id_col=id_col, text_col=text_col, **settings).where("kept").select("_row", F.col(id_col).alias("_own"))
    same = (F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))) == kept["_row"]) & docs[id_col].eqNullSafe(kept["_own"])
    return docs.join(kept, same, "left_semi")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).drop("_row")
