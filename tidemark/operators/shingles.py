"""Sets of shingles of very many texts: which of them may be alike, without a row for each shingle.

Texts are dealt to blocks. A block sends its shingles' hashes to shards of the range of hashes, four bytes for each; a
shard counts in how many texts each occurs and answers every block in the order it asked. A block then knows which of
its sets have enough shingles in common with others at all. Only those go on, rarest shingles first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidemark.scratch import materialize, shuffle_partitions

#: Texts of a block, blocks whose shingles a shard counts, and rows that a text has at least if it counts as frequent.
BLOCK, BLOCKS, FREQUENT = 512, 32, 1000
#: Sets, and members of sets, that are compared with as many others in one go.
SETS, MEMBERS = 512, 1 << 18
LOW = np.uint64(0xFFFFFFFF)


def shingles(text: str, words: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``words`` words of the lower-cased text, sorted; of all words where there are fewer."""
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    grams = lambda w: F.when(F.size(w) < words, F.array(F.array_join(w, " "))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.array_join(F.slice(w, i + 1, words), " "))
    )
    once = F.transform(F.array(split), grams)[0]  # a bound name: an expression would be split anew for each shingle
    return F.sort_array(F.array_distinct(F.transform(once, lambda g: F.xxhash64(g))))


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All members of the sets, and how many each set has."""
    lists = pa.chunked_array(table["g"]).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _places(x: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash and its place there, 32 bits each; in the order of the unsigned hashes."""
    return ((x.view(np.uint64) >> np.uint64(20)) * np.uint64(shards)) >> np.uint64(12)


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as gaps, bytes of equal weight side by side: the shuffle's compression takes the empty ones away."""
    gaps = np.diff(places & LOW, prepend=np.uint64(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64).astype(np.uint32)


def _ask(shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        k = np.sort(_places(_sets(block)[0], shards))
        cuts = np.searchsorted(k, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
        to = np.flatnonzero(np.diff(cuts))
        raw = [_pack(k[cuts[s] : cuts[s + 1]]) for s in to]
        return pa.table({"shard": pa.array(to, pa.int32()), "block": pa.array([block["block"][0].as_py()] * len(to), pa.int32()), "asked": pa.array(raw, pa.binary())})

    return run


def _count(asked: pa.Table) -> pa.Table:
    """0 for a shingle of one text only, else a number that grows with how many have it."""
    parts = [_unpack(raw.as_py()) for raw in asked["asked"]]
    _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    often = np.minimum(np.rint(16 * np.log2(counts)), 255).astype(np.uint8)[which]
    ends = np.cumsum([len(p) for p in parts])
    answers = [often[end - len(p) : end].tobytes() for p, end in zip(parts, ends)]
    return pa.table({"block": asked["block"], "shard": asked["shard"], "often": pa.array(answers, pa.binary())})


def _rare(shards: int, least: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        x, n = _sets(block)
        often = np.empty(len(x), np.uint8)
        by_shard = answers.sort_by("shard")["often"]
        often[np.argsort(_places(x, shards), kind="stable")] = np.frombuffer(b"".join(raw.as_py() for raw in by_shard), np.uint8)
        of = np.repeat(np.arange(len(n)), n)
        alone = np.bincount(of[often == 0], minlength=len(n))
        kept = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1  # the rarest, one of which alike sets share
        stays = alone < np.minimum(kept, n)
        rows = np.flatnonzero(stays)
        mine = stays[of]
        x, often, of = x[mine], often[mine], of[mine]
        x = x[np.lexsort((x, often, of))]
        offsets = np.concatenate(([0], np.cumsum(n[rows]))).astype(np.int32)
        some = block.take(pa.array(rows))
        return pa.table(
            [some["t"], some["first"], some["last"], pa.array(n[rows], pa.int32()), pa.array(alone[rows], pa.int32()), pa.array(np.minimum(kept, n)[rows], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()))], schema=schema
        )

    return run


def candidates(df: DataFrame, text: str, day: str, least: float, words: int) -> DataFrame:
    """Sets that may reach the Jaccard likeness ``least`` with another: h, the hash of the set; first and last day; n; g, its
    shingles, the rarest first; begin and end of those in g that others have too and one of which alike sets share; ts,
    hashes of the texts with this set. Two sets of likeness ``least`` share one of the n - ceil(least n) + 1 rarest of
    each: a set whose rarest all occur in it alone has no such partner and is left out.

    Nothing of the size of a shingle's row is shuffled but for the sets that stay; the texts are shuffled twice instead,
    each time in a job of its own.
    """
    spark = df.sparkSession
    number = F.unix_date(day) if isinstance(df.schema[day].dataType, DateType) else F.floor(day)
    whole = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), F.col(text).alias("_text"), number.cast("bigint").alias("_day"))
    rows, tasks = df.count(), shuffle_partitions(spark)
    blocks = max(1, -(-rows // BLOCK))
    shards = max(tasks, -(-blocks // BLOCKS))
    days = [F.min("_day").alias("first"), F.max("_day").alias("last")]
    counts = whole.groupBy("t").agg(F.count(F.lit(1)).alias("_k"))
    frequent = F.broadcast(materialize(counts.where(F.col("_k") > max(FREQUENT, rows // (4 * tasks))).select("t"), "frequent"))  # at most four for each task

    def sets() -> DataFrame:
        one = [F.any_value("_text").alias("_text"), *days]
        apart = whole.join(frequent, "t").groupBy("t").agg(*one)
        rest = whole.join(frequent, "t", "left_anti").select("t", "_text", F.col("_day").alias("first"), F.col("_day").alias("last"))
        dealt = apart.unionByName(rest).withColumn("block", F.pmod(F.col("t"), F.lit(blocks)).cast("int")).repartition("block")
        each = dealt.groupBy("block", "t").agg(F.any_value("_text").alias("_text"), F.min("first").alias("first"), F.max("last").alias("last"))
        return each.select("block", "t", "first", "last", shingles("_text", words).alias("g"))

    asked = sets().select("block", "g").groupBy("block").applyInArrow(_ask(shards), "shard int, block int, asked binary")
    answers = materialize(asked.groupBy("shard").applyInArrow(_count, "block int, shard int, often binary"), "answers")
    schema = pa.schema([("t", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("g", pa.list_(pa.int64()))])
    rare = sets().groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rare(shards, least, schema), "t bigint, first bigint, last bigint, n int, begin int, end int, g array<bigint>")
    kept = rare.groupBy(F.xxhash64("g").alias("h")).agg(F.any_value(F.struct("n", "begin", "end", "g")).alias("_s"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("t").alias("ts"))
    return materialize(kept.select("h", "first", "last", "_s.*", "ts"), "candidates")


def meeting(sets: DataFrame, days: int, least: float) -> DataFrame:
    """Pairs (h, p) of ``candidates`` that share one of their rarest shingles, could reach ``least`` by their sizes and by the
    place of that shingle, and have days at most ``days`` apart. Of a run of shingles that two sets share, the first counts."""
    at = lambda i: F.struct(F.get("g", i).alias("x"), i.alias("i"), F.get("g", i - 1).alias("before"))
    rows = sets.select("h", "n", "first", "last", F.inline(F.transform(F.sequence("begin", F.col("end") - 1), at)))
    a, b = rows.alias("a"), rows.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    near = (F.col("a.first") - F.col("b.last") <= days) & (F.col("b.first") - F.col("a.last") <= days) & (F.greatest("a.last", "b.last") > F.least("a.first", "b.first"))
    fits = (F.col("a.h") < F.col("b.h")) & (F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= need) & (F.least("a.n", "b.n") >= need) & near
    begins = ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
    return a.join(b, F.col("a.x") == F.col("b.x")).where(fits & begins).select(F.col("a.h").alias("h"), F.col("b.h").alias("p")).distinct()


def _compare(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        x, n = _sets(sets)
        values, x = np.unique(x, return_inverse=True)
        ends, h = np.cumsum(n), sets["h"].to_numpy()
        order = np.argsort(h)
        a, b = (order[np.searchsorted(h, pairs[c].to_numpy(), sorter=order)] for c in "hp")
        common, marked, last = np.empty(len(a), np.int64), np.zeros(len(values), bool), -1
        for k in np.argsort(a, kind="stable"):
            if a[k] != last:
                marked[:] = False
                last = a[k]
                marked[x[ends[last] - n[last] : ends[last]]] = True
            common[k] = np.count_nonzero(marked[x[ends[b[k]] - n[b[k]] : ends[b[k]]]])
        alike = common / (n[a] + n[b] - common)
        return pa.table({"h": pairs["h"], "p": pairs["p"], "s": pa.array(alike)}).filter(pa.array(alike >= least))

    return run


def likeness(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(h, p, s): ``pairs`` of ``candidates`` with their Jaccard likeness, where it is at least ``least``.

    A set is labelled by the least hash among its own and its partners', which copies of one text mostly have in common.
    The pairs between two labels are compared together, so that a set travels once for each and not for each pair; a label
    of many sets is split.
    """
    both = pairs.unionByName(pairs.select(F.col("p").alias("h"), F.col("h").alias("p")))
    labels = materialize(both.groupBy("h").agg(F.least("h", F.min("p")).alias("label")).join(sets.select("h", "n"), "h"), "labels")
    sizes = labels.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("n") / MEMBERS)).alias("_parts"))
    homes = labels.join(sizes, "label").select("h", F.xxhash64("label", F.pmod("h", "_parts")).alias("_home"))
    met = pairs.join(homes, "h").join(homes.select(F.col("h").alias("p"), F.col("_home").alias("_other")), "p")
    met = materialize(met.select("h", "p", F.xxhash64(F.least("_home", "_other"), F.greatest("_home", "_other")).alias("meet")), "met")
    members = met.select(F.col("meet").alias("at"), F.explode(F.array("h", "p")).alias("h")).distinct().join(sets.select("h", "g"), "h")
    return materialize(met.groupBy("meet").cogroup(members.groupBy("at")).applyInArrow(_compare(least), "h bigint, p bigint, s double"), "likeness")
