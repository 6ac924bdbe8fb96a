"""Exact Jaccard self-join of documents' word shingles by universe partition.

Two sets of r and s shingles with similarity t or more differ in at most H = (1 - t) / (1 + t) * (r + s) shingles. Sets
are put into size bands, and a band hashes the universe of shingles into m segments; a pair within H differences agrees
in at least m - H segments. Each set indexes subsets of its segments: all but its m - H - 1 costliest ones, by an order
that depends only on a segment's content (few rare shingles, then few shingles, come first), so that a pair always
shares an entry that both have kept. Bands of short sets, where segments would hold only a few shingles, take half as
many segments instead and index each with its one-deletion neighbourhood; which of both a band takes is decided by cost.
A set also probes the band below, where that may hold partners.

Entries that meet are candidates. Instead of all pairs, members are compared with the least member they meet (a star), and
then only what the links found so far leave in different components is compared with the rest of its star, in bounded
blocks. All comparisons use the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.exchange import mix
from tidemark.operators.components import connected_components
from tidemark.scratch import materialize, shuffle_partitions

WORDS = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
_U = np.uint64


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of lower-cased (A-Z) words between ASCII white space."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=_U, count=len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), dtype=_U)
    for i in range(min(len(h), words)):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def most_apart(r: int, s: int) -> int:
    """Differences that sets of these sizes may have at the threshold."""
    return (r + s) * (DEN - NUM) // (DEN + NUM)


@lru_cache(maxsize=None)
def band_ends(upto: int) -> tuple[int, ...]:
    """Largest sizes of the bands, each about 1.5 times the one before, until ``upto`` is covered."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(max(ends[-1] + 1, ends[-1] * 25 // 16))
    return tuple(ends)


def band_of(n: int) -> int:
    return int(np.searchsorted(band_ends(max(n, 1)), n))


def allocation(band: int, spread: float = 2.5, wanted: float = 3.0) -> tuple[int, int]:
    """(segments, neighbourhoods) of a band: how many segments, and how many of the first have one-deletion entries.

    A set keeps its H + 1 segments of most rare shingles, so more segments than that leave it a choice: with 2.5 times as
    many, a passage that many sets share may fill two thirds of a set before it decides any entry alone.

    An entry costs its row, and a comparison with each other set that shares it by chance, which falls with the number
    of shingles it holds. Whole segments need H + 1 entries of about size / (H + 1) shingles; neighbourhoods need half as
    many segments and as many more entries as there are shingles, each of twice the shingles. Short sets have few
    entries either way, so selectivity decides; long sets have many, so rows decide.
    """
    hi = band_ends(1 << 40)[band]
    apart = most_apart(hi, hi * DEN // NUM)
    whole = apart + 1
    rows = (whole, whole // 2 * (1 + 2 * hi / whole) + whole % 2)
    chance = (0.5 ** (hi / whole), 0.5 ** (2 * hi / whole - 1))
    cost = [r * (1 + 64 / wanted * c) for r, c in zip(rows, chance, strict=True)]
    if apart and hi <= 64 and cost[1] <= 4 * cost[0]:
        return -(-whole // 2), whole // 2
    return int(spread * whole), 0


def entries(sh: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Index entries of one set: those in its own band and those that probe the band below."""
    n = len(sh)
    ends = band_ends(max(n, 1))
    own, mixed = band_of(n), mix(sh)
    if len(common):
        at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
        rare = (common[at] != sh).astype(np.int64)
    else:
        rare = np.ones(n, dtype=np.int64)
    out = [_entries(mixed, rare, own, most_apart(n, n * DEN // NUM))]
    if own and -(-n * NUM // DEN) <= ends[own - 1]:
        out.append(_entries(mixed, rare, own - 1, most_apart(n, min(n, ends[own - 1]))))
    return np.concatenate(out)


def _entries(mixed: np.ndarray, rare: np.ndarray, band: int, apart: int) -> np.ndarray:
    m, near = allocation(band)
    seg = ((mixed >> _U(32)) % _U(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    sizes = np.bincount(seg, minlength=m)
    first = np.cumsum(sizes) - sizes
    content = np.zeros(m, dtype=_U)
    filled = np.flatnonzero(sizes)
    values = mixed[order]
    content[filled] = np.add.reduceat(values, first[filled])
    place = mix(np.arange(m, dtype=_U) + _U(band << 32))
    whole = mix(content + place)
    if near:
        of = seg[order]
        gone = mix(content[of] - values + place[of])[of < near]
        return np.concatenate([whole, gone])
    drop = m - apart - 1
    if drop > 0:
        cost = np.lexsort((whole, sizes, np.bincount(seg, weights=rare, minlength=m)))
        whole = whole[cost[drop:]]
    return whole


#: Names that are not to be used, and the bits of a name.
Shared = tuple[frozenset[int], int]
_PAIRS = pa.schema([("sig", pa.int64()), ("leader", pa.int64()), ("member", pa.int64())])


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, least node, node) for every distinct entry and node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    leader = node[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(sig) else node
    return sig, leader, node


def _index(common: np.ndarray, words: int, shared: Shared):
    """Texts to entries. What meets within a batch is joined to its least node here; only that node travels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, nodes, seen = [], [], set()
            for value in batch.column(0):
                sh = shingles(value.as_py(), words)
                if len(sh) and (node := node_of(sh, shared)[0]) not in seen:  # copies index once
                    seen.add(node)
                    found = entries(sh, common).view(np.int64)
                    sigs.append(found)
                    nodes.append(np.full(len(found), node, dtype=np.int64))
            if sigs:
                cols = _stars(np.concatenate(sigs), np.concatenate(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PAIRS)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a partition to (leader, member, inner) pairs; inner pairs met within a batch already."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    sig, leader, member = (np.concatenate(c) for c in zip(*parts, strict=True))
    inner = leader != member
    _, head, node = _stars(sig[~inner], member[~inner])
    outer = head != node
    for a, b, kind in ((head[outer], node[outer], 0), (leader[inner], member[inner], 1)):
        if len(a):
            pair = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(pair.shape[1], kind, dtype=np.int32))], names=["leader", "member", "inner"])


def node_of(sh: np.ndarray, shared: Shared = (frozenset(), 64)) -> tuple[int, int]:
    """The name of a whole shingle set, and a hash that tells sets apart that would share a name.

    ``shared``: names that several sets had, and the bits of a name. Such a set takes its next hash that is none of them.
    """
    data, (taken, bits), seed = sh.tobytes(), shared, 0
    while (name := int(np.uint64(xxhash.xxh3_64_intdigest(data, seed) >> (64 - bits)).astype(np.int64))) in taken:
        seed += 1
    return name, int(np.uint64(xxhash.xxh64_intdigest(data)).astype(np.int64))


def _describe(words: int, least_share: float, shared: Shared):
    """A row for each document (n, node, guard), and rows (shingle, n) for shingles common within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(v.as_py(), words) for v in batch.column(1)]
            nodes = [node_of(sh, shared) if len(sh) else (None, None) for sh in sets]
            every, n = np.unique(np.concatenate([np.zeros(0, _U), *sets]), return_counts=True)
            often = n >= max(3, least_share * len(sets))
            k, j = len(sets), int(often.sum())
            none = lambda m: [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*batch.column(0).to_pylist(), *none(j)], batch.schema.types[0]), pa.array([*map(len, sets), *n[often].tolist()], pa.int64()),
                    pa.array([*(x for x, _ in nodes), *none(j)], pa.int64()), pa.array([*(x for _, x in nodes), *none(j)], pa.int64()),
                    pa.array([*none(k), *every[often].view(np.int64).tolist()], pa.int64()),
                ],
                names=["_id", "n", "node", "guard", "common"],
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the queries and members of each block; rows come sorted by block, queries first.

    A query's links into one component are given once, by its first member there.
    """
    block, queries, index = None, [], None
    for batch in batches:
        a, b = [], []
        star, qb, mb, role, node, comp = (batch.column(k).to_numpy() for k in range(6))
        sets = batch.column(6)
        for i in range(batch.num_rows):
            at = (star[i], qb[i], mb[i])
            if at != block:
                block, queries, index, told = at, [], None, set()
            sh = sets[i].values.to_numpy().view(_U)
            if role[i] == 0:
                queries.append((int(node[i]), int(comp[i]), sh))
                continue
            if not queries:
                continue
            if index is None:
                flat = np.concatenate([q[2] for q in queries])
                owner = np.repeat(np.arange(len(queries)), [len(q[2]) for q in queries])
                order = np.argsort(flat, kind="stable")
                index = flat[order], owner[order], np.array([len(q[2]) for q in queries]), np.array([q[1] for q in queries])
            flat, owner, sizes, comps = index
            lo, hi = np.searchsorted(flat, sh, "left"), np.searchsorted(flat, sh, "right")
            n = hi - lo
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            at = np.repeat(lo[hit] - np.cumsum(n[hit]) + n[hit], n[hit]) + np.arange(n[hit].sum())
            both = np.bincount(owner[at], minlength=len(queries))
            linked = (DEN * both >= NUM * (sizes + len(sh) - both)) & (comps != comp[i])
            for q in np.flatnonzero(linked):
                if (q, comp[i]) not in told:
                    told.add((q, comp[i]))
                    a.append(queries[q][0])
                    b.append(int(node[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Place of a node among equal parts.
_PART = lambda node="node": F.pmod(F.xxhash64(node), F.lit(1 << 20))


def _links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """``blocks``: star, qb, mb, role, node, comp. The sets are brought in by node and each block is compared by one task."""
    rows = blocks.join(sets, "node").select("star", "qb", "mb", "role", "node", "comp", "sh")
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "star", "qb", "mb").sortWithinPartitions("star", "qb", "mb", "role", "node")
    return dealt.mapInArrow(_verify, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, common_share: float = 0.002,
    entries_per_task: int = 1_000_000, first_turns: int = 6, block: int = 2_000, query_block: int = 500, name_bits: int = 64,
) -> DataFrame:
    """Component of every document under links of similarity 0.8 or more: ``id_col``, n_shingles, component_id.

    component_id is the least id that links reach, the document's own id included. A text of fewer than ``words`` words
    is one shingle; a null text, or one without words, has none and is linked with nothing. Ids are integers; rows that
    repeat an id count as one more document with that id. Rows with a null id take part in links but give no component
    its id unless all ids are null. An empty input gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    # sets that share a name (of n sets some n^2 / 2^65 pairs do) get other ones, until no name is shared
    taken: frozenset[int] = frozenset()
    while True:
        shared = (taken, name_bits)
        described = materialize(texts.mapInArrow(_describe(words, common_share, shared), "_id bigint, n bigint, node bigint, guard bigint, common bigint"), "described")
        rows = described.where("common IS NULL").drop("common")
        nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
            F.min("_id").alias("first"), F.max("n").alias("n"), F.min("guard").alias("g0"), F.max("guard").alias("g1")
        )
        nodes = materialize(nodes, "nodes")
        total, clashes = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("g0") != F.col("g1"))).first()
        if not clashes:
            break
        taken |= {r["node"] for r in nodes.where("g0 <> g1").select("node").collect()}
    # it only orders segments; documents have ``total`` shingles, so at most total / (share of them) reach the share: the
    # list is bounded by the mean size of a document's set, however many documents there are
    documents = F.lit(common_share * rows.where("node IS NOT NULL").count())
    common = described.where("common IS NOT NULL").groupBy("common").agg(F.sum("n").alias("n")).where(F.col("n") >= documents)
    common = common.select("common").toArrow().column(0).to_numpy()
    common = np.sort(common.astype(np.int64).view(_U))

    found = texts.select("_text").mapInArrow(_index(common, words, shared), "sig bigint, leader bigint, member bigint")
    key = F.when(F.col("leader") == F.col("member"), F.col("sig")).otherwise(F.xxhash64("sig", "member"))
    tasks = max(shuffle_partitions(spark), -(-int(0.4 * total) // entries_per_task))
    pairs = materialize(
        found.repartition(tasks, key).mapInArrow(_meet, "leader bigint, member bigint, inner int").distinct(), "pairs"
    )
    # what met within a batch also meets the least node that its own least node met elsewhere
    outer = pairs.where("inner = 0").select("leader", F.col("member").alias("via"))
    inner = pairs.where("inner = 1").select(F.col("leader").alias("via"), "member")
    carried = inner.join(outer, "via").select("leader", "member").where("leader <> member")
    stars = materialize(pairs.select("leader", "member").unionByName(carried).distinct(), "stars")

    wanted = stars.select(F.col("leader").alias("node")).unionByName(stars.select(F.col("member").alias("node"))).distinct()
    wanted = materialize(wanted.join(nodes, "node").select("node", "first"), "wanted")
    # one way at every size: texts are shuffled once more, by id, to the few ids that are compared
    chosen = texts.join(wanted.hint("shuffle_hash"), texts["_id"].eqNullSafe(F.col("first"))).select("node", "_text")
    sets = materialize(chosen.mapInArrow(_sets(words, shared), "node bigint, sh array<bigint>").dropDuplicates(["node"]), "sets")

    # first, each member with the few least nodes that it meets; then with those still in another component
    order = W.partitionBy("member").orderBy(F.xxhash64("leader"), "leader")
    ranked = materialize(stars.withColumn("turn", F.row_number().over(order)), "ranked")
    links = materialize(_star_links(ranked.where(F.col("turn") <= first_turns), sets, block), "links")
    apart = _placed(ranked.where(F.col("turn") > first_turns).select("leader", "member"), connected_components(links)).where("lc <> mc")
    links = links.unionByName(materialize(_star_links(apart.select("leader", "member"), sets, block), "links"))

    # a star whose members are in one component is done; in others, what is outside the largest one meets the rest
    roots = connected_components(links)
    placed = _placed(stars, roots)
    open_ = placed.where("lc <> mc").select(F.col("leader").alias("star")).distinct()
    rows_of = placed.select(F.col("leader").alias("star"), F.col("member").alias("node"), F.col("mc").alias("comp")).unionByName(
        placed.select(F.col("leader").alias("star"), F.col("leader").alias("node"), F.col("lc").alias("comp")).distinct()
    )
    rest = materialize(rows_of.join(open_, "star"), "rest")
    units = _cheaper_units(rest)
    links = links.unionByName(materialize(_rest_links(units, sets, block, query_block), "links"))

    roots = connected_components(links)
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_node = named.join(least, "root").select("node", "least")
    return rows.join(of_node, "node", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "_id").alias("component_id")
    )


def _placed(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """leader, member and the components that both are in (lc, mc)."""
    of = lambda end, name: roots.select(F.col("node").alias(end), F.col("root").alias(name))
    found = stars.select("leader", "member").join(of("leader", "lc"), "leader", "left").join(of("member", "mc"), "member", "left")
    return found.select("leader", "member", F.coalesce("lc", "leader").alias("lc"), F.coalesce("mc", "member").alias("mc"))


def _star_links(pairs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links among pairs of leader and member."""
    sizes = pairs.groupBy(F.col("leader").alias("star")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("mbs"))
    zero = F.lit(0)
    members = pairs.withColumnRenamed("leader", "star").join(sizes, "star").select(
        "star", zero.alias("qb"), (_PART("member") % F.col("mbs")).cast("int").alias("mb"), F.lit(1).alias("role"), F.col("member").alias("node"), F.col("member").alias("comp")
    )
    leaders = sizes.select(
        "star", zero.alias("qb"), F.explode(F.sequence(zero, F.col("mbs") - 1)).alias("mb"), zero.alias("role"), F.col("star").alias("node"), F.col("star").alias("comp")
    )
    return _links(leaders.unionByName(members), sets)


def _open_units(rest: DataFrame) -> DataFrame:
    """Of each star with several components: the largest one, its rows and how many of them are in others."""
    cells = rest.groupBy("star", "comp").agg(F.count(F.lit(1)).alias("k"))
    sums = cells.groupBy("star").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("of"), F.max("k").alias("top"), F.max_by("comp", F.struct("k", "comp")).alias("major"))
    return sums.where("comps > 1").select("star", "major", "of", (F.col("of") - F.col("top")).alias("out"))


def _cheaper_units(rest: DataFrame) -> DataFrame:
    """star, node, comp with the open stars of a cluster put together where that takes fewer comparisons.

    Stars that share nodes form a cluster. Comparing within it covers all of its stars, once for each pair.
    """
    clusters = connected_components(rest.select(F.col("star").alias("a"), F.col("node").alias("b")))
    # each join on a star or cluster ends in a table, so that the adaptive skew join may split a hot one
    tagged = materialize(rest.join(clusters.withColumnsRenamed({"node": "star", "root": "cluster"}), "star"), "tagged")
    alone = _open_units(rest).join(clusters.withColumnsRenamed({"node": "star", "root": "cluster"}), "star").groupBy("cluster").agg(F.sum(F.col("of") * F.col("out")).alias("alone"))
    whole = tagged.select(F.col("cluster").alias("star"), "node", "comp").distinct()
    together = _open_units(whole).select(F.col("star").alias("cluster"), (F.col("of") * F.col("out")).alias("together"))
    merge = materialize(alone.join(together, "cluster").select("cluster", (F.col("together") <= F.col("alone")).alias("merge")), "merge")
    chosen = tagged.join(merge, "cluster").select(F.when(F.col("merge"), F.col("cluster")).otherwise(F.col("star")).alias("star"), "node", "comp")
    return materialize(materialize(chosen, "chosen").distinct(), "units")


def _rest_links(units: DataFrame, sets: DataFrame, block: int, query_block: int) -> DataFrame:
    """Links between each unit's rows outside its largest component and all of its rows in other components than theirs."""
    open_ = _open_units(units).select("star", "major", F.ceil(F.col("of") / block).cast("int").alias("mbs"), F.ceil(F.col("out") / query_block).cast("int").alias("qbs"))
    rest = materialize(units.join(open_, "star"), "open")
    qb, mb = (_PART() % F.col("qbs")).cast("int"), (_PART() % F.col("mbs")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = rest.where("comp <> major").select("star", qb.alias("qb"), every("mbs").alias("mb"), F.lit(0).alias("role"), "node", "comp")
    against = rest.select("star", every("qbs").alias("qb"), mb.alias("mb"), F.lit(1).alias("role"), "node", "comp")
    return _links(queries.unionByName(against), sets)


def _sets(words: int, shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, nodes = [], []
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sh = shingles(value.as_py(), words)
                if len(sh) and node_of(sh, shared)[0] == node:  # of rows that repeat an id, the one meant
                    sets.append(sh.view(np.int64))
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "sh"])

    return run


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
