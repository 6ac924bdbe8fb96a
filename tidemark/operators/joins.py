"""Alignment of messages, features and bars: equi, outer, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.dedup import with_place
from tidemark.operators.ranges import LEAST, running
from tidemark.scratch import materialize


def join_market(features: DataFrame, market: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.join(market, list(keys), "inner")


def attach_annotations(messages: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return messages.join(annotations, key, "left")


def join_outer_all(named: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Series side by side: one column each, a row for every key of any. One shuffle of the union, not a chain of joins."""
    parts = [df.select(key, F.lit(name).alias("_s"), F.col(value).alias("_v")) for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).pivot("_s", list(named)).agg(F.first("_v"))


def join_ffill(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], least: int = LEAST) -> DataFrame:
    """Left join, then the last value seen so far where there is none. A long series is filled in pieces."""
    joined = left.join(right, [*keys, order], "left")
    filled = running(materialize(joined, "joined"), keys, order, lasts={f"_last_{c}": c for c in columns}, least=least)
    return filled.withColumns({c: F.col(f"_last_{c}") for c in columns}).drop(*[f"_last_{c}" for c in columns])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, tolerance: int, bucket: int | None = None) -> DataFrame:
    """The right value nearest in time within ``tolerance``; of equally near ones the later.

    Right rows are copied to the buckets that their tolerance reaches, so each bucket of time is on its own and a key
    with a long history is spread over tasks. Each time of a key should occur once in ``right``.
    """
    size = max(bucket or 0, tolerance, 1)
    at = lambda c: F.floor(c / size)
    r = right.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"))
    r = r.withColumn("_b", F.explode(F.sequence(at(F.col("_t") - tolerance), at(F.col("_t") + tolerance))))
    left = left.withColumn("_b", at(F.col(time)))
    tagged = left.withColumns({"_t": F.col(time), "_k": F.lit(1)}).unionByName(r.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*keys, "_b").orderBy("_t", "_k")
    right_row = F.when(F.col("_k") == 0, F.struct("_t", "_v"))
    before = F.last(right_row, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    later = W.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_k"))
    after = F.last(F.when(F.col("_k") == 0, F.struct("_t", "_v")), ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, 0))
    found = tagged.withColumns({"_before": before, "_after": after}).where("_k = 1")
    back, ahead = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    pick = F.when(ahead.isNotNull() & (back.isNull() | (ahead <= back)), F.struct(ahead.alias("d"), F.col("_after._v").alias("v"))).otherwise(F.struct(back.alias("d"), F.col("_before._v").alias("v")))
    return found.withColumn("_p", pick).select(*[c for c in left.columns if c != "_b"], F.when(F.col("_p.d") <= tolerance, F.col("_p.v")).alias(value))


def sliding_assign(df: DataFrame, time: str, width: int, step: int, closed: str = "left", name: str = "window_end") -> DataFrame:
    """A row for each window end that the row's time falls in; ends are the multiples of ``step``.

    closed "both": [end - width, end]; "left": [end - width, end); "right": (end - width, end].
    """
    first, last = sliding_ends(time, width, step, closed)
    return df.withColumn(name, F.explode(F.sequence(first, last))).withColumn(name, F.col(name) * step)


def sliding_ends(time: str, width: int, step: int, closed: str = "left") -> tuple[Column, Column]:
    """The first and the last window end, in steps, that a row's time falls in; see ``sliding_assign``."""
    t = F.col(time)
    first = F.ceil(t / step) if closed in ("both", "right") else F.floor(t / step) + 1
    last = F.floor((t + width) / step) if closed in ("both", "left") else F.ceil((t + width) / step) - 1
    return first, last


def sliding_sums(df: DataFrame, time: str, width: int, step: int, sums: dict[str, Column], closed: str = "left", keys: Sequence[str] = (), name: str = "window_end") -> DataFrame:
    """(keys, window end, n, sums) of every sliding window that has rows, without a copy of a row for each window.

    A row enters at its first window end and leaves after its last one: two rows of differences, added up by key and end
    before the shuffle, and a running sum over the ends, whatever width / step is. Ends between changes are filled in. Sums
    of whole numbers or decimals are exact; sums of doubles carry the rounding of what has left.
    """
    first, last = sliding_ends(time, width, step, closed)
    sums = {"n": F.lit(1), **sums}
    change = lambda at, sign: F.struct(at.cast("long").alias("_at"), *[(F.coalesce(c, F.lit(0)) * sign).alias(n) for n, c in sums.items()])
    changes = df.select(*keys, F.inline(F.array(change(first, 1), change(last + 1, -1)))).groupBy(*keys, "_at").agg(*[F.sum(n).alias(n) for n in sums])
    w = W.partitionBy(*keys).orderBy("_at")  # one row for each end at which something changes: the calendar bounds them
    held = [F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(n) for n in sums]
    spans = changes.select(*keys, "_at", *held, F.lead("_at").over(w).alias("_next")).where("n > 0")
    return spans.withColumn(name, F.explode(F.sequence("_at", F.col("_next") - 1))).withColumn(name, F.col(name) * step).drop("_at", "_next")


def events_before_spikes(events: DataFrame, spikes: DataFrame, day: str, ahead: int = 1) -> DataFrame:
    """Events exactly ``ahead`` days before a spike (equi join on the shifted day)."""
    return events.withColumn("spike_day", F.col(day) + ahead).join(spikes.withColumnRenamed(day, "spike_day"), "spike_day")


def unordered_pairs(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Pairs a < b of distinct entities that share the keys; groups are the few entities of one event."""
    one = df.select(*keys, entity).distinct()
    return one.withColumnRenamed(entity, "a").join(one.withColumnRenamed(entity, "b"), list(keys)).where("a < b")


def top_k_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def restrict_topk(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent; the list has ``k`` rows, so it is broadcast."""
    return df.join(F.broadcast(top_k_values(df, column, k).select(column)), column, "left_semi")


def entity_index(df: DataFrame, column: str, by: str = "frequency") -> DataFrame:
    """Dense ids from 0 of the distinct values, by falling frequency (then value) or by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col(column)] if by == "frequency" else [F.col(column)]
    return with_place(counts, "id", *order).select(column, "n", "id")


def known_event_entities(events: DataFrame, entities: DataFrame, key: str = "event") -> DataFrame:
    """Known entities of each event with an array of names, joined in sorted order."""
    flat = events.select(key, F.explode("entities").alias("entity")).join(entities, "entity")
    return flat.groupBy(key).agg(F.count(F.lit(1)).alias("n_entities"), F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("names"))
