"""Deduplication, selection, set operations and splits of messages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import materialize

#: Aliases that may go to every task: some tens of megabytes as an automaton.
MOST_ALIASES = 200_000


def dedup_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row for each key, the first or last in ``order``, which should name a unique column last."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def alias_hits(df: DataFrame, name: str, aliases: Sequence[tuple[int, str]], whole_word: bool = False, out: str = "hits") -> DataFrame:
    """``df`` with the distinct numbers of the aliases within the lower-cased ``name`` (as whole words if asked), as an array.

    All aliases are one Aho-Corasick automaton, built once a task, so a name costs one pass over its characters however
    many aliases there are. ``aliases`` go to every task and are held to ``MOST_ALIASES``. An empty alias is in every name.
    """
    import ahocorasick

    if len(aliases) > MOST_ALIASES:
        raise ValueError(f"{len(aliases)} aliases; at most {MOST_ALIASES} go to every task")
    pad = " " if whole_word else ""
    always = sorted({k for k, a in aliases if not pad + a + pad})
    numbers: dict[str, set[int]] = {}
    for k, a in aliases:
        if pad + a + pad:
            numbers.setdefault(pad + a + pad, set()).add(k)

    @F.pandas_udf("array<int>")
    def hits(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word, of in numbers.items():
            automaton.add_word(word, tuple(sorted(of)))
        if numbers:
            automaton.make_automaton()
        for batch in names:
            yield pd.Series([sorted({*always, *(k for _, of in (automaton.iter(pad + text + pad) if numbers else ()) for k in of)}) for text in batch])

    return df.withColumn(out, hits(F.lower(F.coalesce(F.col(name), F.lit("")))))


def select_asset_target(df: DataFrame, assets: DataFrame, key: str = "msg_id", whole_word: bool = False) -> DataFrame:
    """The target of greatest impact (missing: 0; first of equals) of each message for each asset it names.

    ``assets``: asset, tickers, aliases (arrays); a target fits by upper-cased ticker or by an alias within its
    lower-cased name (as a whole word if asked). Tickers are joined by equality with a list of
    checked size; aliases are found by ``alias_hits``.
    """
    listed = assets.select("asset", "tickers", "aliases").limit(MOST_ALIASES + 1).collect()  # configuration; alias_hits checks its size
    words = [(i, a) for i, r in enumerate(listed) for a in (r["aliases"] or []) if a is not None]
    t = df.select(key, F.posexplode("targets").alias("pos", "t")).select(key, "pos", "t.name", F.upper(F.coalesce("t.ticker", F.lit(""))).alias("_ticker"), F.struct("t.sentiment", "t.impact", "t.category").alias("t"))
    names = F.lit([r["asset"] for r in listed]).cast("array<string>")
    by_ticker: dict[str, list[str]] = {}
    for asset, ticker in sorted({(r["asset"], x) for r in listed for x in (r["tickers"] or []) if x is not None}):
        by_ticker.setdefault(ticker, []).append(asset)
    if len(by_ticker) > MOST_ALIASES:
        raise ValueError(f"{len(by_ticker)} tickers; at most {MOST_ALIASES} go to every task")
    tickers = F.broadcast(df.sparkSession.createDataFrame(list(by_ticker.items()), "_ticker string, _by_ticker array<string>"))  # bounded above
    hits = alias_hits(t, "name", words, whole_word).join(tickers, "_ticker", "left")
    own = F.array_distinct(F.concat(F.transform("hits", lambda i: F.get(names, i)), F.coalesce("_by_ticker", F.array().cast("array<string>"))))
    each = hits.select(key, "pos", "t", F.explode(own).alias("asset"))
    first = F.max_by(F.struct("pos", "t"), F.struct(F.coalesce("t.impact", F.lit(0)).alias("i"), (-F.col("pos")).alias("p")))
    picked = each.groupBy("asset", key).agg(first.alias("_b")).select("asset", key, "_b.pos", "_b.t")
    return picked.select("asset", key, "pos", F.coalesce("t.sentiment", F.lit(0)).alias("sentiment"), F.coalesce(F.nullif("t.impact", F.lit(0)), F.lit(1)).alias("impact"), F.coalesce("t.category", F.lit("UNKNOWN")).alias("category"))


def anti_unprocessed(df: DataFrame, done: DataFrame, key: str = "text") -> DataFrame:
    """Rows whose text is not among those done; joined by hash and text, so that short hashes are compared first."""
    side = done.select(F.xxhash64(key).alias("_h"), F.col(key).alias("_k")).distinct()
    return df.join(side, (F.xxhash64(df[key]) == F.col("_h")) & (df[key] == F.col("_k")), "left_anti")


def with_place(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """Add ``column``, the global place in any order from 0: rows are range-partitioned and written, ranked within their
    range, and moved on by the sizes of the ranges before."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_k"))  # one row for each range
    first = sizes.select("_b", F.coalesce(F.sum("_k").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(first), "_b").withColumn(column, F.col("_first") + F.col("_r")).drop("_b", "_r", "_first")


def assign_batches(df: DataFrame, n: int, order: str) -> DataFrame:
    """batch 0 to n - 1 of contiguous rows, total // n each; the last takes the remainder."""
    total = df.count()
    size = max(1, total // n)
    return with_place(df, "_pos", F.col(order)).withColumn("batch", F.least(F.floor(F.col("_pos") / size), F.lit(n - 1)).cast("int")).drop("_pos")


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_annotations(base: DataFrame, retry: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows found in ``retry`` take its values, nulls included."""
    new = retry.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(base.columns)


def corpus_overlap(a: DataFrame, b: DataFrame, column: str = "text") -> DataFrame:
    """Distinct values on each side, on both, and on either, in one aggregate."""
    sides = a.select(F.col(column).alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(column).alias("v"), F.lit(2).alias("s")))
    each = sides.groupBy("v").agg(F.max((F.col("s") == 1).cast("int")).alias("a"), F.max((F.col("s") == 2).cast("int")).alias("b"))
    return each.agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"), F.sum(F.col("a") * F.col("b")).alias("in_both"), F.count(F.lit(1)).alias("in_either"))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows of lowest hash: the same ones each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def failed_rows(messages: DataFrame, errors: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with an error, with the first of theirs."""
    return messages.join(dedup_keep(errors, [key], [order]), key)


def merge_mentions(mentions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of repeated mentions of one entity in one event, the last."""
    return dedup_keep(mentions, keys, order, keep="last")


def top_by(df: DataFrame, groups: Sequence[str], value: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows of greatest value in each group; ties by ``tie``."""
    w = W.partitionBy(*groups).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def argmax(df: DataFrame, groups: Sequence[str], value: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The columns of each group's row of greatest value (of equals, the least ``tie``), without a sort."""
    best = F.min_by(F.struct(*columns), F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t")))
    return df.groupBy(*groups).agg(best.alias("_b")).select(*groups, "_b.*")


def global_top(df: DataFrame, value: str, k: int, tie: str, bottom: bool = False) -> DataFrame:
    return df.orderBy(F.asc(value) if bottom else F.desc(value), tie).limit(k)


def concentration(df: DataFrame, source: Column | str) -> DataFrame:
    """Rows of each source and their share of all."""
    s = F.col(source) if isinstance(source, str) else source
    counts = df.groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("_all")).alias("share"))
