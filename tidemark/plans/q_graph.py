"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup as C
from tidemark.operators import graph as G
from tidemark.operators import series as S
from tidemark.plans.registry import query, r6

_ONE = "one AS (SELECT event_id, day, entity, sentiment, impact FROM (SELECT *, row_number() OVER (PARTITION BY event_id, entity ORDER BY pos DESC, l_partkey DESC, impact DESC, sentiment DESC) AS n FROM v_mention) WHERE n = 1)"
_PAIRS = "p AS (SELECT a.event_id, a.day, a.entity AS src, b.entity AS dst, abs(a.sentiment - b.sentiment) AS gap FROM one a JOIN one b ON a.event_id = b.event_id AND a.entity < b.entity)"
_E = f"WITH {_ONE}, {_PAIRS}, e AS (SELECT src, dst, count(*) AS weight, avg(gap) AS avg_gap FROM p GROUP BY 1, 2 HAVING count(*) >= {{0}})"
_D = "d AS (SELECT node, count(*) AS degree, sum(weight) AS weighted FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1)"
_WE = f"WITH {_ONE}, {_PAIRS}, e AS (SELECT w AS win, src, dst, count(*) AS weight FROM (SELECT *, unnest([day, day + 1, day + 2]) AS w FROM p) GROUP BY 1, 2, 3)"
_WD = "d AS (SELECT win, node, count(*) AS degree, sum(weight) AS weighted FROM (SELECT win, src AS node, weight FROM e UNION ALL SELECT win, dst, weight FROM e) GROUP BY 1, 2)"


def one(view):
    return C.merge_mentions(view("v_mention"), ["event_id", "entity"], ["pos", "l_partkey", "impact", "sentiment"])


def edges(view, least=3):
    return G.cooccurrence(one(view), least)


def by_window(view):
    return G.windowed_cooccurrence(one(view), "day", 3)


@query("SELECT event_id, count(*) AS n, CAST(sum(coalesce(CASE WHEN impact % 3 = 0 THEN NULL ELSE impact END, 5)) AS BIGINT) AS impact FROM v_mention WHERE l_partkey % 10 > 1 GROUP BY 1")
def h1_mentions(view, table):
    m = view("v_mention")
    name = F.when(F.col("l_partkey") % 10 == 0, F.lit(None)).when(F.col("l_partkey") % 10 == 1, "unknown").otherwise(F.col("entity"))
    t = F.struct(name.alias("name"), F.lit(None).cast("string").alias("ticker"), F.col("type"), F.col("sentiment"), F.when(F.col("impact") % 3 != 0, F.col("impact")).alias("impact"), F.col("category"))
    msgs = m.groupBy("event_id").agg(F.collect_list(t).alias("targets"))
    return G.mentions(msgs, "event_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("impact").alias("impact"))


@query(f"{_E.format(3)} SELECT src, dst, weight, round(avg_gap, 6) AS avg_gap FROM e")
def h2_cooccurrence(view, table):
    return edges(view).withColumn("avg_gap", r6("avg_gap"))


@query(f"{_WE} SELECT win, src, dst, weight FROM e WHERE weight >= 2")
def h3_windowed_cooccurrence(view, table):
    return by_window(view).where("weight >= 2").withColumnRenamed("window", "win")


@query(f"{_WE}, {_WD} SELECT win, count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, round(avg(weighted), 6) AS avg_weighted, CAST(max(weighted) AS BIGINT) AS max_weighted, round(CASE WHEN count(*) > 1 THEN sum(degree) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS density FROM d GROUP BY 1")
def h4_graph_basics(view, table):
    return G.graph_basics(by_window(view), ["window"]).withColumnRenamed("window", "win").withColumns({c: r6(c) for c in ("avg_degree", "avg_weighted", "density")})


@query(f"{_E.format(3)}, {_D} SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d")
def h5_degree_centrality(view, table):
    return G.degree_centrality(edges(view)).withColumn("centrality", r6("centrality"))


@query(f"{_WE}, {_WD} SELECT win, coalesce(max(degree) FILTER (WHERE node = 'e1'), 0) AS e1, coalesce(max(degree) FILTER (WHERE node = 'e2'), 0) AS e2, coalesce(max(degree) FILTER (WHERE node = 'e3'), 0) AS e3 FROM d GROUP BY 1")
def h5_hub_degrees(view, table):
    return G.hub_degrees(by_window(view), ["e1", "e2", "e3"], ["window"]).withColumnRenamed("window", "win")


@query(f"{_WE}, {_WD}, t AS (SELECT a.win, count(*) AS t FROM e a JOIN e b ON a.win = b.win AND a.dst = b.src JOIN e c ON a.win = c.win AND a.src = c.src AND b.dst = c.dst GROUP BY 1), w AS (SELECT win, sum(degree * (degree - 1) / 2) AS w FROM d GROUP BY 1) SELECT w.win, round(coalesce(3 * t / nullif(w, 0), 0), 4) AS transitivity FROM w LEFT JOIN t ON w.win = t.win")
def h6_transitivity(view, table):
    return G.transitivity(by_window(view), ["window"]).select(F.col("window").alias("win"), r6("transitivity", 4).alias("transitivity"))


@query(f"{_WE}, {_WD}, r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY weighted, node) AS i FROM d) SELECT win, round(2 * sum(i * weighted) / (count(*) * sum(weighted)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini FROM r GROUP BY 1")
def h7_gini(view, table):
    return G.gini(G.degrees(by_window(view), ["window"]), "weighted", ["window"]).select(F.col("window").alias("win"), r6("gini").alias("gini"))


@query(f"{_WE}, {_WD}, t AS (SELECT win, list(node) AS top FROM (SELECT win, node, row_number() OVER (PARTITION BY win ORDER BY degree DESC, node) AS r FROM d) WHERE r <= 10 GROUP BY 1), b AS (SELECT win, top, lag(top) OVER (ORDER BY win) AS old FROM t) SELECT win, round(len(list_intersect(top, old)) / len(list_distinct(list_concat(top, old))), 6) AS stability FROM b WHERE old IS NOT NULL")
def h8_topk_stability(view, table):
    return G.topk_jaccard(G.degrees(by_window(view), ["window"]), "window").where("stability IS NOT NULL").select(F.col("window").alias("win"), r6("stability").alias("stability"))


@query(f"""WITH RECURSIVE {_ONE}, p AS (SELECT a.day AS win, a.entity AS src, b.entity AS dst FROM one a JOIN one b ON a.event_id = b.event_id AND a.entity < b.entity),
u AS (SELECT DISTINCT win, src, dst FROM p UNION SELECT DISTINCT win, dst, src FROM p), r AS (SELECT DISTINCT win, src AS node, src AS root FROM u UNION SELECT r.win, u.dst, r.root FROM r JOIN u ON r.win = u.win AND r.node = u.src),
c AS (SELECT win, node, min(root) AS root FROM r GROUP BY 1, 2) SELECT win, count(DISTINCT root) AS components FROM c GROUP BY 1""")
def h9_components(view, table):
    e = G.event_pairs(one(view), carry=["day"]).select(F.col("day").alias("win"), "src", "dst").distinct()
    return G.components(e, ["win"])


@query(f"""{_E.format(3).replace("WITH ", "WITH RECURSIVE ", 1)}, b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), o AS (SELECT src, sum(weight) AS w, count(*) OVER () AS n FROM b GROUP BY 1),
t AS (SELECT b.src, b.dst, CAST(weight AS DOUBLE) / w AS p, n FROM b JOIN o ON b.src = o.src),
r AS (SELECT 0 AS k, src AS node, 1 / CAST(n AS DOUBLE) AS rank FROM o UNION ALL SELECT r.k + 1, t.dst, CAST(0.15 AS DOUBLE) / max(t.n) + CAST(0.85 AS DOUBLE) * sum(r.rank * t.p) FROM r JOIN t ON r.node = t.src WHERE r.k < 150 GROUP BY 1, 2)
SELECT node, round(rank, 6) AS rank FROM r WHERE k = 150""")
def h10_pagerank(view, table):
    return G.pagerank(edges(view)).withColumn("rank", r6("rank"))


@query(None)
def h11_communities(view, table):
    e = edges(view)
    labels = G.communities(e)
    return G.modularity(e, labels).withColumn("modularity", r6("modularity"))


@query(f"{_E.format(3)}, {_D}, l AS (SELECT node, length(node) AS c FROM d), m AS (SELECT sum(weight) AS m FROM e), i AS (SELECT a.c, sum(CASE WHEN a.c = b.c THEN weight ELSE 0 END) AS w FROM e JOIN l a ON src = a.node JOIN l b ON dst = b.node GROUP BY 1), g AS (SELECT c, sum(weighted) AS d FROM d JOIN l ON d.node = l.node GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - power(d / (2 * m), 2)), 6) + 0.0 AS modularity FROM g LEFT JOIN i ON g.c = i.c, m")
def h12_modularity(view, table):
    e = edges(view)
    labels = G.degrees(e).select("node", F.length("node").alias("community"))
    return G.modularity(e, labels).withColumn("modularity", r6("modularity"))


@query(None)
def h11_windowed_communities(view, table):
    """Communities and their modularity of each 3-day window."""
    return G.community_stats(by_window(view), ["window"]).select(F.col("window").alias("win"), "communities", r6("modularity").alias("modularity"))


@query(f"{_WE}, l AS (SELECT win, src, dst, weight, length(src) AS a, length(dst) AS b FROM e), m AS (SELECT win, sum(weight) AS m, sum(CASE WHEN a = b THEN weight ELSE 0 END) AS w FROM l GROUP BY 1), g AS (SELECT win, c, sum(weight) AS d FROM (SELECT win, a AS c, weight FROM l UNION ALL SELECT win, b, weight FROM l) GROUP BY 1, 2), s AS (SELECT win, sum(d * d) AS dd FROM g GROUP BY 1) SELECT m.win, round(w / m - dd / (4 * m * m), 6) + 0.0 AS modularity FROM m JOIN s ON m.win = s.win")
def h12_windowed_modularity(view, table):
    """Modularity in each 3-day window of given labels, here the length of the name."""
    e = by_window(view)
    labels = G.degrees(e, ["window"]).select("window", "node", F.length("node").alias("community"))
    return G.modularity(e, labels, ["window"]).select(F.col("window").alias("win"), r6("modularity").alias("modularity"))


@query(f"{_WE}, {_WD}, x AS (SELECT e.win, a.weighted AS x, b.weighted AS y FROM e JOIN d a ON e.win = a.win AND src = a.node JOIN d b ON e.win = b.win AND dst = b.node), u AS (SELECT * FROM x UNION ALL SELECT win, y, x FROM x) SELECT win, round(CASE WHEN var_pop(x) > 0 THEN corr(x, y) ELSE 0 END, 6) + 0.0 AS assortativity FROM u GROUP BY 1")
def h13_assortativity(view, table):
    return G.assortativity(by_window(view), ["window"]).select(F.col("window").alias("win"), r6("assortativity").alias("assortativity"))


@query(f"""{_E.format(3).replace("WITH ", "WITH RECURSIVE ", 1)}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT src AS node FROM b),
r AS (SELECT 0 AS k, node AS root, node, CAST(1 AS DOUBLE) AS w FROM v UNION ALL SELECT r.k + 1, r.root, b.dst, sum(r.w) FROM r JOIN b ON r.node = b.src WHERE r.k < 12 GROUP BY 1, 2, 3),
s AS (SELECT root, node, min(k) AS d, arg_min(w, k) AS w FROM r GROUP BY 1, 2),
u AS (SELECT a.node, sum(a.w * c.w / t.w) AS dep FROM s t JOIN s a ON a.root = t.root JOIN s c ON c.root = a.node AND c.node = t.node WHERE a.d + c.d = t.d AND a.node <> t.root AND a.node <> t.node GROUP BY 1),
n AS (SELECT count(*) AS n FROM v) SELECT v.node, round(coalesce(dep, 0) / greatest((n - 1) * (n - 2), 1), 6) AS betweenness FROM v CROSS JOIN n LEFT JOIN u ON v.node = u.node""")
def h14_betweenness(view, table):
    return G.betweenness(edges(view)).withColumn("betweenness", r6("betweenness"))


@query(f"{_WE}, {_WD}, c AS (SELECT win, degree / nullif(count(*) OVER (PARTITION BY win) - 1, 0) AS c FROM d), m AS (SELECT win, avg(c) AS mu, var_pop(c) AS v FROM c GROUP BY 1) SELECT c.win, round(CASE WHEN max(v) > 1e-18 THEN avg(power(c - mu, 3)) / power(max(v), 1.5) ELSE 0 END, 4) + 0.0 AS skewness, round(max(c), 6) AS most FROM c JOIN m ON c.win = m.win GROUP BY 1")
def h15_centralization(view, table):
    c = G.degree_centrality(by_window(view), ["window"])
    return G.centralization(c, "centrality", ["window"]).select(F.col("window").alias("win"), r6("skewness", 4).alias("skewness"), r6("most").alias("most"))


@query("WITH d AS (SELECT day, entity, count(*) AS degree FROM v_mention GROUP BY 1, 2) SELECT day, count(*) AS entities, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, round(coalesce(stddev_samp(degree), 0), 6) AS std_degree, CAST(sum(degree) AS BIGINT) AS mentions FROM d GROUP BY 1")
def h16_daily_degree(view, table):
    return G.daily_degree(view("v_mention")).withColumns({"avg_degree": r6("avg_degree"), "std_degree": r6("std_degree")})


@query(f"WITH {_ONE} SELECT a.entity AS src, b.entity AS dst, count(*) AS n FROM one a JOIN one b ON a.event_id = b.event_id AND a.entity < b.entity AND a.sentiment < 0 AND b.sentiment < 0 GROUP BY 1, 2")
def h17_negative_pairs(view, table):
    return G.negative_pairs(one(view))


@query(f"{_E.format(1)} SELECT src, dst, weight AS n, round(avg_gap, 6) AS avg_gap FROM e ORDER BY weight DESC, src, dst LIMIT 20")
def h17_top_pairs(view, table):
    return G.top_pairs(one(view)).withColumn("avg_gap", r6("avg_gap"))


@query("""WITH s AS (SELECT b.symbol, day FROM v_bars b JOIN (SELECT symbol, avg(volume) + 1.5 * stddev_samp(volume) AS t FROM v_bars GROUP BY 1) t ON b.symbol = t.symbol WHERE volume > t),
d AS (SELECT DISTINCT day FROM s), n AS (SELECT event_id, m.day, min(d.day) AS spike FROM (SELECT DISTINCT event_id, day FROM v_mention) m JOIN d ON d.day > m.day AND d.day <= m.day + 3 GROUP BY 1, 2)
SELECT entity, count(DISTINCT spike) AS spikes, count(*) AS events, round(avg(spike - day), 6) AS mean_ahead FROM (SELECT DISTINCT event_id, day, entity FROM v_mention) JOIN n USING (event_id, day) GROUP BY 1""")
def h17_entities_before_spikes(view, table):
    """Event, entity, spike: who is mentioned within three days before a spike of any symbol's volume."""
    days = S.spike_flags(view("v_bars"), "volume", [1.5], ["symbol"]).where("spike_1_5").select("day").distinct()
    return G.entities_before_spikes(view("v_mention"), days, "day", 3).withColumn("mean_ahead", r6("mean_ahead"))


@query(f"{_E.format(3)}, t AS (SELECT max(weight) AS top FROM e), n AS (SELECT src, dst, round(weight / top, 6) AS weight FROM e, t) SELECT * FROM n UNION ALL SELECT dst, src, weight FROM n")
def h3_static_adjacency(view, table):
    return G.static_adjacency(one(view)).withColumn("weight", r6("weight"))


@query("""WITH m AS (SELECT msg_id, CAST(floor(sec / 86400) AS BIGINT) AS win, category AS entity, impact FROM v_signal),
b AS (SELECT win, entity, count(*) AS n, sum(impact) AS impact FROM m GROUP BY 1, 2), v AS (SELECT vec_id, embedding[1] AS e1, embedding[64] AS e64 FROM embeddings)
SELECT b.win, b.entity, n, impact, round(x, 5) + 0.0 AS first, round(y, 5) + 0.0 AS last FROM b LEFT JOIN (SELECT win, entity, avg(e1) AS x, avg(e64) AS y FROM m JOIN v ON msg_id = vec_id GROUP BY 1, 2) s ON b.win = s.win AND b.entity = s.entity""")
def h18_snapshot_nodes(view, table):
    m = view("v_signal").select("msg_id", "sec", F.col("category").alias("entity"), "impact")
    vectors = table("embeddings").select(F.col("vec_id").alias("msg_id"), F.col("embedding").alias("vector"))
    out = G.snapshot_nodes(m, vectors, F.floor(F.col("sec") / 86400))
    return out.select(F.col("window").alias("win"), "entity", "n", "impact", r6(F.get("vector", F.lit(0)), 5).alias("first"), r6(F.get("vector", F.lit(63)), 5).alias("last"))


@query(f"WITH {_ONE}, {_PAIRS}, d AS (SELECT DISTINCT CAST(floor(day / 30) AS BIGINT) AS win, src, dst FROM p) SELECT * FROM d UNION ALL SELECT win, dst, src FROM d")
def h19_snapshot_edges(view, table):
    return G.snapshot_edges(one(view), F.floor(F.col("day") / 30)).withColumnRenamed("window", "win")


@query('SELECT count(*) AS "rows", count(e.vec_id) AS covered, round(count(e.vec_id) / count(*), 6) AS coverage, 0 AS repeated FROM events LEFT JOIN embeddings e ON event_id = vec_id')
def h20_embedding_coverage(view, table):
    out = G.embedding_coverage(table("events").select(F.col("event_id").alias("id")), table("embeddings").select(F.col("vec_id").alias("id")), "id")
    return out.withColumn("coverage", r6("coverage"))


@query(f"{_E.format(3)}, v AS (SELECT DISTINCT entity, category FROM v_mention) SELECT 'vertex' AS kind, category AS label, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'edge', CASE WHEN weight >= 20 THEN 'strong' ELSE 'weak' END, count(*) FROM e GROUP BY 2")
def e17_graph_report(view, table):
    v = view("v_mention").select("entity", F.col("category").alias("label")).distinct()
    return G.graph_report(v, edges(view).withColumn("type", F.when(F.col("weight") >= 20, "strong").otherwise("weak")))


@query("SELECT category, count(*) AS mentions FROM v_mention GROUP BY 1")
def e17_mentions_per_category(view, table):
    return G.mentions_per_category(view("v_mention"))


@query("""WITH s AS (SELECT symbol, avg(volume) + 1.5 * stddev_samp(volume) AS t FROM v_bars GROUP BY 1)
SELECT year(DATE '1970-01-01' + CAST(day AS INT)) AS year, count(*) AS spikes, round(avg(volume), 6) AS mean_size FROM v_bars b JOIN s ON b.symbol = s.symbol WHERE volume > t GROUP BY 1""")
def e17_spikes_per_year(view, table):
    spikes = S.spike_flags(view("v_bars"), "volume", [1.5], ["symbol"]).where("spike_1_5")
    return G.spikes_per_year(spikes, "day", "volume").withColumn("mean_size", r6("mean_size"))


@query("WITH l AS (SELECT user_id, msg_id, sec, lag(msg_id) OVER (PARTITION BY user_id ORDER BY sec, msg_id) AS before, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, msg_id) AS delta FROM v_signal) SELECT * FROM l WHERE delta <= 86400")
def m1_temporal_follows(view, table):
    return G.temporal_follows(view("v_signal"), "user_id", "sec", "msg_id", 86400)


@query("WITH s AS (SELECT DISTINCT sec FROM v_signal WHERE value > 480) SELECT msg_id, v.sec, min(s.sec) AS spike, min(s.sec) - v.sec AS ahead FROM v_signal v JOIN s ON s.sec > v.sec AND s.sec <= v.sec + 7200 GROUP BY 1, 2")
def m2_precedes_spike(view, table):
    s = view("v_signal")
    return G.precedes_spike(s.select("msg_id", "sec"), s.where("value > 480").select("sec").distinct(), "sec", 7200)


@query("""WITH g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER w < 21600 THEN 0 ELSE 1 END AS b FROM v_signal WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(sec) AS first, max(sec) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def l7_sessions(view, table):
    return G.sessions(view("v_signal"), "user_id", "sec", 21600)


@query("""WITH w AS (SELECT msg_id, day, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM v_message),
s AS (SELECT msg_id, day, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
x AS (SELECT msg_id, day, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.msg_id, a.n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY a.msg_id, a.n, b.msg_id, b.n),
t AS (SELECT msg_id, max(c / (n + m - c)) AS s FROM p GROUP BY 1)
SELECT CASE WHEN s >= 0.95 THEN 'reprint' WHEN s >= 0.5 THEN 'update' ELSE 'new' END AS status, count(*) AS n FROM v_message v LEFT JOIN t ON v.msg_id = t.msg_id GROUP BY 1""")
def m7_text_novelty(view, table):
    return G.text_novelty(view("v_message"), "day", 7, 0.5).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
