"""Windows over series of any length: a key with more rows than a quarter of an even task is cut into pieces of its order.

Frames of a bounded number of rows get the rows they reach in the neighbouring pieces as copies (a halo); running sums and
last values are taken within pieces and moved on by what the pieces before add up to. Keys of ordinary length go
through one window by key. Pieces are cut at quantiles, so their lists are bounded by the number of shuffle
partitions and not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import materialize, shuffle_partitions

LEAST = 1_000_000


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of two frames' keys."""
    return reduce(lambda on, c: on & a[c].eqNullSafe(b[c]), keys, F.lit(True))


def _named(keys: Sequence[str]) -> dict[str, str]:
    return {c: f"_of_{c}" for c in keys}


def _join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of a small table that has a row for each of its keys; at most a few for each partition."""
    other = F.broadcast(small.withColumnsRenamed(_named(keys)))
    on = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))
    return df.join(other, on, how).drop(*_named(keys).values())


def _place(cuts: str, x: str) -> Column:
    """How many of the sorted ``cuts`` are below ``x``, by bisection."""
    mid = "shiftright(s.lo + s.hi, 1)"
    step = f"IF(s.lo >= s.hi, s, IF(get({cuts}, {mid}) < {x}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))"
    return F.expr(f"aggregate(sequence(1, 40), named_struct('lo', 0, 'hi', size({cuts})), (s, k) -> {step}, s -> s.lo)")


def long_keys(df: DataFrame, keys: Sequence[str], least: int = LEAST) -> tuple[DataFrame, int, int]:
    """The keys of more rows than ``least`` and a quarter of an even task (with _rows), that bound, and the most rows of a key (0
    if none is long). At most four keys for each partition, as their rows are among all rows."""
    sizes = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    total, largest = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    most = max(least, total // (4 * shuffle_partitions(df.sparkSession)))
    return sizes.where(F.col("_rows") > most), most, largest if largest > most else 0


def split_long(df: DataFrame, keys: Sequence[str], least: int = LEAST) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of long ones)."""
    long, _, largest = long_keys(df, keys, least)
    if not largest:
        return df, None
    return _join(df, long.drop("_rows"), keys, "left_anti"), _join(df, long.drop("_rows"), keys, "left_semi")


def cut(df: DataFrame, keys: Sequence[str], order: str, least: int = LEAST) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of long keys with _piece). Rows of equal ``order`` stay in one piece; nulls are in the first."""
    keys = list(keys)
    long, most, largest = long_keys(df, keys, least)
    if not largest:
        return df, None
    parts = -(-largest // most)
    of_long = _join(df, long, keys)
    quantiles = of_long.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), [k / parts for k in range(1, parts)], 100 * parts).alias("_q"), F.first("_rows").alias("_rows"))
    own = F.ceil(F.col("_rows") / most)
    picked = F.transform(F.sequence(F.lit(1), own - 1), lambda k: F.get("_q", (k * parts / own).cast("int") - 1))
    cuts = materialize(quantiles.where(own > 1).select(*keys, F.array_sort(F.array_distinct(picked)).alias("_cuts")), "cuts")
    rest = _join(df, long.drop("_rows"), keys, "left_anti")
    x = F.col(order).cast("double")
    pieces = _join(of_long.drop("_rows").withColumn("_cut_by", x), cuts, keys).withColumn("_piece", F.coalesce(_place("_cuts", "_cut_by"), F.lit(0)))
    return rest, pieces.drop("_cuts", "_cut_by")


def bounded(
    df: DataFrame, keys: Sequence[str], order: str, before: int, after: int, compute: Callable[[DataFrame, list[str]], DataFrame], least: int = LEAST, number: str | None = None,
) -> DataFrame:
    """``compute(frame, keys)``, whose windows by ``keys`` and ``order`` reach at most so many rows back and ahead.

    For pieces it is called with the piece among the keys; it must keep the column ``_halo``, which marks copies. ``number``
    names a column of the frame with the row's place in the whole series, from 1.
    """
    keys = list(keys)
    rest, long = cut(df, keys, order, least)
    if number:
        rest = rest.withColumn(number, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long"))
    found = compute(rest.withColumn("_halo", F.lit(False)), keys).drop("_halo")
    if long is None:
        return found
    numbered = materialize(long.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(order)) - 1), "pieces")
    sizes = numbered.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_k"))
    first = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = sizes.withColumn("_from", first).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_piece", F.struct("_from", "_k")))).alias("_starts"))
    at = _join(numbered, materialize(lists, "starts"), keys).withColumn("_at", F.expr("_starts[_piece]._from + _row"))
    if number:
        at = at.withColumn(number, F.col("_at") + 1)
    reached = F.expr(
        f"map_keys(map_filter(_starts, (p, s) -> (s._from > _at AND s._from - _at <= {before}) OR (s._from + s._k - 1 < _at AND _at - (s._from + s._k - 1) <= {after})))"
    )
    laid = at.withColumn("_to", F.explode(F.concat(F.array("_piece"), reached))).withColumn("_halo", F.col("_to") != F.col("_piece")).drop("_starts", "_at", "_row", "_piece")
    own = compute(laid, [*keys, "_to"]).where("NOT _halo").drop("_halo", "_to")
    return found.unionByName(own)


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, least: int = LEAST) -> DataFrame:
    """``df`` with running columns in ``order`` (unique within a key): ``sums`` maps new names to columns added up over the rows
    before, ``lasts`` to columns whose last value that is not null, the row's own included, is carried on."""
    keys, sums, lasts = list(keys), sums or {}, lasts or {}

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(order)
        add = {n: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for n, c in sums.items()}
        return rows.withColumns({**add, **{n: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) for n, c in lasts.items()}})

    rest, long = cut(df, keys, order, least)
    found = within(rest, keys)
    if long is None:
        return found
    long = materialize(long, "pieces")
    totals = long.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_t_{n}") for n, c in lasts.items()], F.count(F.lit(1)).alias("_k"))
    w = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # one row a piece
    carried = totals.select(*keys, "_piece", *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_c_{n}") for n in sums], *[F.last(f"_t_{n}", ignorenulls=True).over(w).alias(f"_c_{n}") for n in lasts])
    moved = _join(within(long, [*keys, "_piece"]), materialize(carried, "carried"), [*keys, "_piece"])
    moved = moved.withColumns({**{n: F.col(n) + F.col(f"_c_{n}") for n in sums}, **{n: F.coalesce(n, f"_c_{n}") for n in lasts}})
    return found.unionByName(moved.select(found.columns))


def beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a table that has one row for each of its keys, null ones included."""
    if not keys:
        return df.crossJoin(F.broadcast(small))  # one row
    on = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))
    return df.join(small.withColumnsRenamed(_named(keys)), on).drop(*_named(keys).values())


def value_counts(df: DataFrame, keys: Sequence[str], value: str, least: int = LEAST) -> DataFrame:
    """keys, ``value``, _k rows of it and _below rows of lower values in its key: ranks without a sort of the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    return running(materialize(counts, "counts"), keys, value, {"_below": "_k"}, least=least)


def key_medians(df: DataFrame, keys: Sequence[str], columns: dict[str, str], least: int = LEAST) -> DataFrame:
    """keys and the median of each column under the name it is mapped to, from counts of distinct values; null where a key has
    no value."""
    out = df.select(*keys).distinct()
    for c, name in columns.items():
        counts = materialize(value_counts(df, keys, c, least), "medians")
        placed = beside(counts, counts.groupBy(*keys).agg(F.sum("_k").alias("_n")), keys)
        at = lambda n: F.max(F.when(F.col("_below") <= F.floor(n), F.col(c)))
        middle = placed.groupBy(*keys).agg(((at((F.col("_n") - 1) / 2) + at(F.col("_n") / 2)) / 2).alias(name)).withColumnsRenamed(_named(keys))
        on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))
        out = out.join(middle, on, "left").drop(*_named(keys).values())
    return out


def average_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], least: int = LEAST) -> DataFrame:
    """``df`` with each column replaced by its average rank from 1 within the key; nulls stay.

    The rank of a value is found from counts of distinct values, so tied rows, however many, are one row until the join.
    """
    keys = list(keys)
    for c in columns:
        counts = value_counts(df, keys, c, least)
        ranks = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(c).alias("_v"), (F.col("_below") + (F.col("_k") + 1) / 2).alias("_rank"))
        on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.col(c) == F.col("_v"))
        df = df.join(materialize(ranks, "ranks"), on, "left").withColumn(c, F.col("_rank")).drop("_rank", "_v", *_named(keys).values())
    return df
