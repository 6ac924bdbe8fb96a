"""Entity co-occurrence graphs: edges, windows, and topology metrics by window.

Edges are undirected and given once with src < dst; a window column, where there is one, is part of every key, so all
windows are measured in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.operators.dedup import with_place
from tidemark.operators.ranges import LEAST, running, value_counts
from tidemark.operators.series import corr
from tidemark.operators.shingles import candidates, likeness, meeting
from tidemark.scratch import materialize


def mentions(df: DataFrame, key: str = "msg_id", targets: str = "targets") -> DataFrame:
    """A row for each target with a name: impact 5, type and category OTHER where they are missing."""
    t = df.select(key, F.posexplode(targets).alias("pos", "t"))
    name = F.trim(F.coalesce("t.name", F.lit("")))
    return t.where((name != "") & (F.upper(name) != "UNKNOWN")).select(
        key, "pos", name.alias("entity"), F.col("t.ticker").alias("ticker"), F.coalesce("t.type", F.lit("OTHER")).alias("type"),
        F.coalesce("t.sentiment", F.lit(0)).alias("sentiment"), F.coalesce("t.impact", F.lit(5)).alias("impact"), F.coalesce("t.category", F.lit("OTHER")).alias("category"),
    )


def event_pairs(m: DataFrame, event: str = "event_id", carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of entities of one event, src < dst, with |difference| of sentiment. Each event has one row per entity."""
    a = m.select(event, *carry, F.col("entity").alias("src"), F.col("sentiment").alias("_s"))
    b = m.select(event, F.col("entity").alias("dst"), F.col("sentiment").alias("_d"))
    return a.join(b, event).where("src < dst").withColumn("gap", F.abs(F.col("_s") - F.col("_d"))).drop("_s", "_d")


def pairs_of(names: Column | str) -> Column:
    """All pairs (src, dst) of a sorted array of distinct names, as an array: for explode, where there is no table of mentions."""
    c = F.col(names) if isinstance(names, str) else names
    return F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))


@F.udtf(returnType="src string, dst string")
class EntityPairs:
    """Table function of SQL: the pairs of entities of each event, src < dst.

    ``SELECT * FROM entity_pairs(TABLE(mentions) PARTITION BY event_id)``; the table's last column is the entity, the
    partition its event. A call holds the distinct entities of one event, which are few.
    """

    def __init__(self):
        self.names: set[str] = set()

    def eval(self, row):
        if (name := row[len(row) - 1]) is not None:
            self.names.add(name)

    def terminate(self):
        names = sorted(self.names)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                yield a, b


def register_table_functions(spark) -> None:
    """``entity_pairs`` for SQL users."""
    spark.udtf.register("entity_pairs", EntityPairs)


def cooccurrence(m: DataFrame, least: int = 3, event: str = "event_id") -> DataFrame:
    edges = event_pairs(m, event).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.avg("gap").alias("avg_gap"))
    return edges.where(F.col("weight") >= least)


def windowed_cooccurrence(m: DataFrame, day: str, days: int, event: str = "event_id") -> DataFrame:
    """Edges of the events of each day and the ``days`` - 1 before. A pair's daily count enters on its day and leaves ``days``
    later: two rows however wide the window is, and a running sum over the pair's days, of which the calendar has few."""
    daily = event_pairs(m, event, [day]).groupBy("src", "dst", day).agg(F.count(F.lit(1)).alias("_k"))
    change = lambda at, k: F.struct(at.alias("_at"), k.alias("_k"))
    moves = daily.select("src", "dst", F.inline(F.array(change(F.col(day), F.col("_k")), change(F.col(day) + days, -F.col("_k"))))).groupBy("src", "dst", "_at").agg(F.sum("_k").alias("_k"))
    w = W.partitionBy("src", "dst").orderBy("_at")
    spans = moves.select("src", "dst", "_at", F.sum("_k").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("weight"), F.lead("_at").over(w).alias("_next")).where("weight > 0")
    return spans.select(F.explode(F.sequence("_at", F.col("_next") - 1)).alias("window"), "src", "dst", "weight")


def static_adjacency(m: DataFrame, least: int = 2, event: str = "event_id") -> DataFrame:
    """(src, dst, weight): pairs that occur together more than ``least`` times, both ways, over the greatest of them."""
    e = materialize(event_pairs(m, event).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least), "edges")
    top = F.broadcast(e.agg(F.max("n").alias("_top")))  # one row
    one = e.crossJoin(top).select("src", "dst", (F.col("n") / F.col("_top")).alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def top_pairs(m: DataFrame, k: int = 20, event: str = "event_id") -> DataFrame:
    """The ``k`` pairs that occur together most often, with how often and their mean difference of sentiment."""
    e = event_pairs(m, event).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("avg_gap"))
    return e.orderBy(F.desc("n"), "src", "dst").limit(k)


def entities_before_spikes(m: DataFrame, spikes: DataFrame, time: str, most: int, event: str = "event_id") -> DataFrame:
    """(entity, spikes, events, mean_ahead): what is mentioned in events whose next spike is at most ``most`` ahead. The next
    spike hangs on the time alone, so it is looked up once for each time, and an entity's events are counted by time before."""
    ahead = precedes_spike(m.select(time).distinct(), spikes, time, most).select(time, "spike", "ahead")
    found = m.select(event, time, "entity").distinct().groupBy("entity", time).agg(F.count(F.lit(1)).alias("_k")).join(ahead, time)
    mean = F.sum(F.col("_k") * F.col("ahead")) / F.sum("_k")
    return found.groupBy("entity").agg(F.countDistinct("spike").alias("spikes"), F.sum("_k").alias("events"), mean.alias("mean_ahead"))


def _ends(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    weight = F.col("weight") if "weight" in e.columns else F.lit(1)
    return e.select(*keys, F.explode(F.array("src", "dst")).alias("node"), weight.alias("weight"))


def degrees(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _ends(e, keys).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"))


def graph_basics(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """nodes, edges, density, mean and greatest degree, plain and weighted."""
    d = degrees(e, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
        F.avg("weighted").alias("avg_weighted"), F.max("weighted").alias("max_weighted"),
    )
    return d.withColumn("density", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def degree_centrality(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = degrees(e, keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys)) if keys else F.lit(d.count())
    return d.select(*keys, "node", "degree", F.coalesce(F.col("degree") / F.nullif(n - 1, F.lit(0)), F.lit(0.0)).alias("centrality"))


def hub_degrees(e: DataFrame, hubs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Degree of named nodes, a column each, 0 where a node is absent."""
    count = lambda h: F.coalesce(F.max(F.when(F.col("node") == h, F.col("degree"))), F.lit(0)).alias(h)
    return degrees(e, keys).groupBy(*keys).agg(*[count(h) for h in hubs])


def triangles(e: DataFrame, keys: Sequence[str] = (), d: DataFrame | None = None) -> DataFrame:
    """Triangles by keys: for each edge, how many neighbours its ends share. Nodes are numbered by keys and
    degree and edges turned to the higher number, so no list of neighbours is longer than the root of twice the edges, and
    each triangle counts once. The tables are short as files and long in memory, so they are merged, never broadcast."""
    pairs = e.select(*keys, "src", "dst").distinct()
    d = (degrees(e, keys) if d is None else d).select(*keys, "node", "degree")
    ids = materialize(with_place(d, "_id", *keys, F.col("degree"), F.col("node")).select(*keys, "node", "_id"), "numbers").hint("merge")
    numbered = pairs.join(ids.withColumnsRenamed({"node": "src", "_id": "_s"}), [*keys, "src"]).join(ids.withColumnsRenamed({"node": "dst", "_id": "_d"}), [*keys, "dst"])
    out = numbered.select(*keys, F.least("_s", "_d").alias("a"), F.greatest("_s", "_d").alias("b"))
    lists = materialize(out.groupBy(*keys, "a").agg(F.collect_list("b").alias("of_a")), "neighbours")
    edges = lists.select(*keys, "of_a", F.explode("of_a").alias("b"))
    both = edges.join(lists.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")).hint("merge"), "b")
    return both.groupBy(*keys).agg(F.sum(F.size(F.array_intersect("of_a", "of_b"))).alias("triangles"))


def transitivity(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Three times the triangles over the connected triples, 0 without triples. The edges are made once and written."""
    e = materialize(e.select(*keys, "src", "dst").distinct(), "edges")
    d = materialize(degrees(e, keys), "degrees")
    triples = d.groupBy(*keys).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    t = triangles(e, keys, d)
    joined = triples.join(t, list(keys), "left") if keys else triples.crossJoin(t)  # one row each
    return joined.select(*keys, F.coalesce(3 * F.col("triangles") / F.nullif("triples", F.lit(0.0)), F.lit(0.0)).alias("transitivity"))


def gini(df: DataFrame, c: str, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """Gini coefficient of the sorted values: 2 sum(i x) / (n sum(x)) - (n + 1) / n; 0 where they add up to 0. Places i come
    from counts of equal values, which take consecutive places, so ``tie`` decides nothing."""
    v = value_counts(df, keys, c)
    places = F.col("_k") * F.col("_below") + F.col("_k") * (F.col("_k") + 1) / 2
    s = v.groupBy(*keys).agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col(c)).alias("_all"), F.sum(places * F.col(c)).alias("_i"))
    g = 2 * F.col("_i") / F.nullif(F.col("_n") * F.col("_all"), F.lit(0)) - (F.col("_n") + 1) / F.col("_n")
    return s.select(*keys, F.coalesce(g, F.lit(0.0)).alias("gini"))


def topk_jaccard(d: DataFrame, window: str, k: int = 10, value: str = "degree") -> DataFrame:
    """Likeness of each window's ``k`` greatest nodes to those of the window before (null for the first)."""
    r = F.row_number().over(W.partitionBy(window).orderBy(F.desc(value), "node"))
    tops = d.withColumn("_r", r).where(F.col("_r") <= k).groupBy(window).agg(F.collect_set("node").alias("top"))
    before = F.lag("top").over(W.orderBy(window))  # one row of k names for each window
    return tops.withColumn("_b", before).select(window, (F.size(F.array_intersect("top", "_b")) / F.size(F.array_union("top", "_b"))).alias("stability"))


def components(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, components): all windows converge together, as nodes are (window, node)."""
    tag = lambda c: F.to_json(F.struct(*keys, F.col(c).alias("node")))
    roots = connected_components(e.select(tag("src").alias("a"), tag("dst").alias("b")))
    back = [F.get_json_object("root", f"$.{k}").cast(e.schema[k].dataType).alias(k) for k in keys]
    return roots.select("root").distinct().groupBy(*back).agg(F.count(F.lit(1)).alias("components"))


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """Weighted PageRank of an undirected graph; every node has an edge, so none dangles. Raises if ranks still change by
    more than n * ``tolerance`` in sum after ``rounds`` rounds."""
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("_all"))
    share = materialize(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("p")), "transitions")
    nodes = share.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        moved = share.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.lit((1 - damping) / max(n, 1)) + damping * F.sum(F.col("p") * F.col("rank"))).alias("rank"))
        if k % 5 == 4:
            moved = materialize(moved, "ranks")
            change = moved.join(ranks.withColumnRenamed("rank", "_o"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_o")))).first()[0]
            if change is None or change < n * tolerance:
                return moved
        ranks = moved
    raise RuntimeError(f"PageRank did not converge in {rounds} rounds")


def _local_moves(e: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    """(keys, node, community): nodes move to the neighbouring community of greatest gain in modularity, about a third of them
    at a time (other ones in each round). A graph in which no node would gain is settled and leaves the loop, so later
    rounds touch the others only; at most ``rounds`` rounds. ``e`` has each edge both ways and self loops once."""
    degree = e.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    labels = materialize(degree.withColumn("_total", F.sum("k").over(W.partitionBy(*keys))).select(*keys, "node", F.col("node").alias("community"), "k", "_total"), "strength")
    settled = []
    for r in range(rounds):
        size = labels.groupBy(*keys, "community").agg(F.sum("k").alias("_tot"))
        to = labels.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_to"))
        links = e.where("src <> dst").join(to, [*keys, "dst"]).groupBy(*keys, "src", "_to").agg(F.sum("weight").alias("_w"))
        own = labels.select(*keys, F.col("node").alias("src"), F.col("community").alias("_own"), "k", "_total")
        stay = own.select(*keys, "src", F.col("_own").alias("_to"), F.lit(0.0).alias("_w"))
        near = links.unionByName(stay).groupBy(*keys, "src", "_to").agg(F.sum("_w").alias("_w")).join(own, [*keys, "src"]).join(size.withColumnRenamed("community", "_to"), [*keys, "_to"])
        rest = F.col("_tot") - F.when(F.col("_to") == F.col("_own"), F.col("k")).otherwise(0.0)
        gain = F.col("_w") - F.col("k") * rest / F.col("_total")
        # a move needs a gain beyond rounding; equal ones go to the least label
        best = near.groupBy(*keys, F.col("src").alias("node")).agg(
            F.max(F.when(F.col("_to") == F.col("_own"), gain)).alias("_stay"), F.max_by("_to", F.struct(F.round(gain, 9).alias("g"), F.xxhash64("_to").alias("h"))).alias("_best"), F.max(gain).alias("_gain")
        )
        gains, turn = F.col("_gain") > F.col("_stay") + 1e-9, F.pmod(F.xxhash64("node", F.lit(r)), F.lit(3)) == 0
        moved = labels.join(best, [*keys, "node"]).select(*keys, "node", F.when(gains & turn, F.col("_best")).otherwise(F.col("community")).alias("community"), "k", "_total", gains.alias("_gains"))
        moved = materialize(moved.withColumn("_open", F.max("_gains").over(W.partitionBy(*keys))), "labels")
        settled.append(moved.where("NOT _open").select(*keys, "node", "community"))
        labels = moved.where("_open").drop("_gains", "_open")
        if labels.isEmpty():
            break
        e = e.join(labels.select(*keys).distinct(), list(keys), "left_semi")
    settled.append(labels.select(*keys, "node", "community"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return materialize(out, "moves")


def _gain_moves(near: list[dict[int, float]], strength: list[float], total: float) -> list[int]:
    """Community of each node after moves one by one to the neighbouring community of greatest gain, until none gains."""
    of, held, moved = list(range(len(near))), strength.copy(), True
    while moved:
        moved = False
        for v, links in enumerate(near):
            to: dict[int, float] = {}
            for u, w in links.items():
                if u != v:
                    to[of[u]] = to.get(of[u], 0.0) + w
            own = best = of[v]
            held[own] -= strength[v]
            gain = to.get(own, 0.0) - strength[v] * held[own] / total + 1e-9 * strength[v]
            for c in sorted(to):
                if (g := to[c] - strength[v] * held[c] / total) > gain:
                    best, gain = c, g
            held[best] += strength[v]
            moved, of[v] = moved or best != own, best
    return of


def _partition(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """(keys, node, community) of one graph that fits a task: moves of nodes, then of the communities found, until none gains."""
    ends = pa.concat_arrays([*table.column("src").chunks, *table.column("dst").chunks]).dictionary_encode()
    names, code = ends.dictionary, ends.indices.to_numpy()
    m = table.num_rows
    near: list[dict[int, float]] = [{} for _ in range(len(names))]
    for a, b, w in zip(code[:m].tolist(), code[m:].tolist(), table.column("weight").to_pylist(), strict=True):
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    total, label = sum(sum(x.values()) for x in near), list(range(len(near)))
    while total:
        of = _gain_moves(near, [sum(x.values()) for x in near], total)
        if of == list(range(len(near))):
            break
        dense = {c: k for k, c in enumerate(sorted(set(of)))}
        of = [dense[c] for c in of]
        label, merged = [of[c] for c in label], [{} for _ in dense]
        for v, links in enumerate(near):
            for u, w in links.items():
                merged[of[v]][of[u]] = merged[of[v]].get(of[u], 0.0) + w
        near = merged
    least: dict[int, int] = {}
    for v, c in enumerate(label):
        least.setdefault(c, v)
    same = [pa.array([table.column(c)[0].as_py()] * len(names), table.schema.field(c).type) for c in keys]
    return pa.Table.from_arrays([*same, names, names.take(pa.array([least[c] for c in label]))], names=[*keys, "node", "community"])


def communities(e: DataFrame, keys: Sequence[str] = (), rounds: int = 30, small: int = 100_000) -> DataFrame:
    """(keys, node, community) by modularity, of all graphs at once; a community is named by one of its nodes.

    A graph of at most ``small`` edges is solved by one task, as windows of a long history are many small graphs. Larger
    ones are solved together in Spark: local moves of nodes, then of the communities found as nodes of a smaller graph, for as
    long as a graph's modularity rises; it then leaves with the labels before. A level that does not settle in ``rounds``
    rounds counts only if it raises modularity too. Graphs without weight keep a community a node."""
    if not keys:
        return communities(e.withColumn("_graph", F.lit(0)), ["_graph"], rounds, small).drop("_graph")
    keys = list(keys)
    e = materialize(e.select(*keys, "src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    sizes = materialize(e.groupBy(*keys).agg((F.count(F.lit(1)) <= small).alias("_small")), "sizes")
    pick = lambda which: e.join(sizes.where(which).select(*keys), keys, "left_semi")
    of = lambda c, t: f"`{c}` {e.schema[t].dataType.simpleString()}"
    kinds = ", ".join([*(of(c, c) for c in keys), of("node", "src"), of("community", "src")])
    done = [pick("_small").groupBy(*keys).applyInArrow(lambda t: _partition(t, keys), kinds)]
    if not (large := sizes.where("NOT _small")).isEmpty():
        done.append(_large_communities(e.join(large.select(*keys), keys, "left_semi"), keys, rounds))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _large_communities(e: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    e = materialize(e, "edges")
    both = materialize(e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "both")
    labels, best, done = both.select(*keys, F.col("src").alias("node"), F.col("src").alias("community")).distinct(), None, []
    while not e.isEmpty():
        moves = _local_moves(both, keys, rounds)
        up = moves.select(*keys, F.col("node").alias("community"), F.col("community").alias("_up"))
        found = materialize(labels.join(up, [*keys, "community"]).select(*keys, "node", F.col("_up").alias("community")), "communities")
        q = modularity(e, found, keys)
        if best is not None:
            q = q.join(best.withColumnRenamed("modularity", "_before"), keys, "left")
        better = F.lit(True) if best is None else F.coalesce(F.col("modularity") > F.col("_before") + 1e-12, F.lit(False))
        q = materialize(q.select(*keys, "modularity", better.alias("_up")), "modularity")
        best, flat = q.where("_up").drop("_up"), q.where("NOT _up").select(*keys)
        done.append(labels.join(flat, keys, "left_semi"))
        open_ = best.select(*keys)
        labels, e, moves = (d.join(open_, keys, "left_semi") for d in (found, e, moves))
        to = lambda end: moves.select(*keys, F.col("node").alias(end), F.col("community").alias(f"_{end}"))  # noqa: E731, B023
        both = materialize(both.join(to("src"), [*keys, "src"]).join(to("dst"), [*keys, "dst"]).groupBy(*keys, F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("weight").alias("weight")), "both")
        labels, e = materialize(labels, "open_labels"), materialize(e, "open_edges")
    out = labels
    for part in done:
        out = out.unionByName(part.select(out.columns))
    return out


def modularity(e: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, modularity): sum over communities of (inner weight / m - (degrees / 2m) squared)."""
    of = lambda end, name: labels.select(*keys, F.col("node").alias(end), F.col("community").alias(name))
    ends = e.join(of("src", "_a"), [*keys, "src"]).join(of("dst", "_b"), [*keys, "dst"])
    part = lambda end, inner: ends.select(*keys, F.col(end).alias("community"), "weight", inner.alias("_in"))
    # an edge counts in the degrees of both ends and, if they are together, once as inner weight
    both = part("_a", F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0)).unionByName(part("_b", F.lit(0)))
    each = both.groupBy(*keys, "community").agg(F.sum("weight").alias("_d"), F.sum("_in").alias("_in"))
    found = each.groupBy(*keys).agg((F.sum("_d") / 2).alias("_m"), F.sum("_in").alias("_in"), F.sum(F.col("_d") * F.col("_d").cast("double")).alias("_dd"))
    return found.select(*keys, (F.col("_in") / F.col("_m") - F.col("_dd") / (4 * F.col("_m") * F.col("_m"))).alias("modularity"))


def community_stats(e: DataFrame, keys: Sequence[str], rounds: int = 30) -> DataFrame:
    """(keys, communities, modularity) of every graph: how many communities there are and the modularity of that
    partition."""
    e = materialize(e.select(*keys, "src", "dst", "weight"), "windows")
    labels = materialize(communities(e, keys, rounds), "labels")
    counts = labels.groupBy(*keys).agg(F.countDistinct("community").alias("communities"))
    return counts.join(modularity(e, labels, keys), list(keys))


def assortativity(e: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the weighted degrees at both ends, each edge both ways; 0 where undefined."""
    e = materialize(e.select(*keys, "src", "dst", "weight"), "edges")
    d = materialize(degrees(e, keys).select(*keys, "node", "weighted"), "degrees")
    x = e.join(d.withColumnsRenamed({"node": "src", "weighted": "_x"}), [*keys, "src"]).join(d.withColumnsRenamed({"node": "dst", "weighted": "_y"}), [*keys, "dst"])
    both = x.select(*keys, "_x", "_y").unionByName(x.select(*keys, F.col("_y").alias("_x"), F.col("_x").alias("_y")))
    return both.groupBy(*keys).agg(F.coalesce(corr("_x", "_y"), F.lit(0.0)).alias("assortativity"))


def betweenness(e: DataFrame, sources: int = 100, top: int = 1000) -> DataFrame:
    """Sampled betweenness on the subgraph of the ``top`` nodes by degree: shortest paths from ``sources`` nodes of
    lowest hash, all at once, level by level out, however deep they go, and back. Scaled to all sources; the subgraph
    bounds the work."""
    keep = degrees(e).orderBy(F.desc("degree"), "node").limit(top).select("node")
    sub = e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = materialize(sub.select("src", "dst").unionByName(sub.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "adjacency")
    nodes = both.select(F.col("src").alias("node")).distinct()
    start = nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    n, k = nodes.count(), start.count()
    seen = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("level"), F.lit(1.0).alias("paths"))
    levels = 0
    while True:
        level = levels
        step = seen.where(F.col("level") == level).join(both, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        new = step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(level + 1).alias("level"), "paths")
        grown = materialize(seen.unionByName(new), "levels")
        if grown.where(F.col("level") == level + 1).isEmpty():
            break
        seen, levels = grown, level + 1
    deps = seen.select("root", "node", "level", "paths", F.lit(0.0).alias("dep"))
    for level in range(levels, 0, -1):
        low = deps.where(F.col("level") == level).select("root", F.col("node").alias("w"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        up = low.join(both, low["w"] == both["src"]).join(deps.where(F.col("level") == level - 1).select("root", F.col("node").alias("dst"), F.col("paths").alias("p")), ["root", "dst"])
        add = up.groupBy("root", F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("p")).alias("add"))
        deps = materialize(deps.join(add, ["root", "node"], "left").select("root", "node", "level", "paths", (F.col("dep") + F.coalesce("add", F.lit(0.0))).alias("dep")), "dependencies")
    scale = n / max(k, 1) / max(1, (n - 1) * (n - 2))
    found = deps.where("level > 0").groupBy("node").agg((F.sum("dep") * scale).alias("betweenness"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def centralization(c: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Population skewness and maximum of a centrality; skewness 0 where all are equal."""
    skew = F.when(F.var_pop(value) > 1e-18, F.skewness(value)).otherwise(0.0)
    return c.groupBy(*keys).agg(skew.alias("skewness"), F.max(value).alias("most"))


def daily_degree(m: DataFrame, day: str = "day") -> DataFrame:
    d = m.groupBy(day, "entity").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy(day).agg(F.count(F.lit(1)).alias("entities"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("std_degree"), F.sum("degree").alias("mentions"))


def negative_pairs(m: DataFrame, event: str = "event_id") -> DataFrame:
    """Pairs that are negative together, with how often."""
    return event_pairs(m.where("sentiment < 0"), event).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def snapshot_nodes(m: DataFrame, vectors: DataFrame, window: Column, key: str = "msg_id") -> DataFrame:
    """Count, total impact and mean vector of each entity and window, in one row for each mention."""
    rows = m.withColumn("window", window)
    base = rows.groupBy("window", "entity").agg(F.count(F.lit(1)).alias("n"), F.sum("impact").alias("impact"))
    with_v = rows.join(vectors, key).select("window", "entity", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    mean = with_v.groupBy("window", "entity").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vector"))
    return base.join(mean, ["window", "entity"], "left")


def snapshot_edges(m: DataFrame, window: Column, event: str = "event_id") -> DataFrame:
    """Distinct directed pairs by window, both ways."""
    one = event_pairs(m.withColumn("window", window).select(event, "window", "entity", F.lit(0).alias("sentiment")), event, ["window"]).select("window", "src", "dst").distinct()
    return one.unionByName(one.select("window", F.col("dst").alias("src"), F.col("src").alias("dst")))


def embedding_coverage(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows, rows with a vector, share covered, and keys that have more than one vector."""
    per = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    return ids.join(per, key, "left").agg(F.count(F.lit(1)).alias("rows"), F.count("_k").alias("covered"), (F.count("_k") / F.count(F.lit(1))).alias("coverage"), F.count_if(F.col("_k") > 1).alias("repeated"))


def graph_report(v: DataFrame, e: DataFrame) -> DataFrame:
    """(kind, label, n) of vertices (label) and edges (type)."""
    return v.groupBy(F.lit("vertex").alias("kind"), "label").agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def mentions_per_category(m: DataFrame, category: str = "category") -> DataFrame:
    return m.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("mentions"))


def spikes_per_year(spikes: DataFrame, day: str, value: str) -> DataFrame:
    """Spikes and their mean size by calendar year; ``day`` counts days since 1970."""
    year = F.year(F.date_from_unix_date(F.col(day).cast("int"))).alias("year")
    return spikes.groupBy(year).agg(F.count(F.lit(1)).alias("spikes"), F.avg(value).alias("mean_size"))


def temporal_follows(m: DataFrame, entity: str, time: str, event: str, most: int) -> DataFrame:
    """Consecutive events of one entity at most ``most`` apart."""
    w = W.partitionBy(entity).orderBy(time, event)
    out = m.select(entity, event, time, F.lag(event).over(w).alias("before"), (F.col(time) - F.lag(time).over(w)).alias("delta"))
    return out.where(F.col("delta") <= most)


def precedes_spike(events: DataFrame, spikes: DataFrame, time: str, most: int, keys: Sequence[str] = (), least: int = LEAST) -> DataFrame:
    """Each event with the next spike (of its keys) later than itself and at most ``most`` ahead.

    Events and spikes are laid in one order, latest first, and the last spike seen is carried on: no pairs are formed, and
    a long history is cut into pieces. ``time`` is a whole number.
    """
    e = events.withColumns({"_spike": F.lit(None).cast("long"), "_o": -2 * F.col(time) - 1})  # before a spike of its own time
    s = spikes.select(*keys, F.col(time).cast("long").alias("_spike"), (-2 * F.col(time)).alias("_o"))
    laid = materialize(e.unionByName(s, allowMissingColumns=True).withColumn("_event", F.col("_o") % 2 != 0), "laid")
    seen = running(laid, keys, "_o", lasts={"spike": "_spike"}, least=least)
    near = seen.where(F.col("_event") & (F.col("spike") - F.col(time) <= most)).drop("_spike", "_o", "_event")
    return near.withColumn("ahead", F.col("spike") - F.col(time))


def sessions(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Runs of a key's rows less than ``gap`` apart: first, last, n."""
    w = W.partitionBy(key).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) >= gap).cast("int"), F.lit(1))
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def text_novelty(df: DataFrame, day: str, days: int, least: float, key: str = "msg_id", text: str = "text", words: int = 3) -> DataFrame:
    """new, update or reprint of each message by its greatest Jaccard likeness to those of the ``days`` before: reprint from
    0.95 on, update from ``least`` on. likeness is exact where it reaches ``least`` and 0 below.

    Sets that can have a partner at all (``shingles.candidates``) meet on one of their rarest shingles; the rest are new
    unless their own text came before. Equal texts are compared once.
    """
    sets = candidates(df, text, day, least, words)
    pairs = materialize(meeting(sets, days, least), "pairs")
    like = likeness(sets, pairs, least)
    texts = df.select(key, day, F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("t"))
    rows = materialize(texts.join(sets.select("h", F.explode("ts").alias("t")), "t", "left").select(key, day, F.coalesce("h", "t").alias("h")), "rows")
    equal = rows.where("h IS NOT NULL").select("h").distinct().select("h", F.col("h").alias("p"), F.lit(1.0).alias("s"))
    every = like.unionByName(like.select(F.col("p").alias("h"), F.col("h").alias("p"), "s")).unionByName(equal)
    seen = rows.select("h", day).distinct()
    past = seen.select(F.col("h").alias("p"), F.explode(F.sequence(F.col(day) + 1, F.col(day) + days)).alias(day)).distinct()
    best = seen.join(every, "h").join(past, ["p", day]).groupBy("h", day).agg(F.max("s").alias("likeness"))
    status = F.when(F.col("likeness") >= 0.95, "reprint").when(F.col("likeness") >= least, "update").otherwise("new")
    found = rows.select(key, "h", day).join(best, ["h", day], "left").select(key, F.coalesce("likeness", F.lit(0.0)).alias("likeness"))
    return found.withColumn("status", status)
