"""Queries of the batch-model hooks and of table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hooks
from tidemark.operators import graph as G
from tidemark.plans.registry import query, r6


@query("""WITH w AS (SELECT msg_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM v_message), c AS (SELECT msg_id, count(*) FILTER (WHERE w IN ('the', 'of')) AS p, count(*) FILTER (WHERE w IN ('and', 'der')) AS n FROM w GROUP BY 1)
SELECT msg_id, round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END, 6) + 0.0 AS score FROM c""")
def k1_text_scorer(view, table):
    score = hooks.text_scorer(hooks.lexicon(("the", "of"), ("and", "der")))
    return view("v_message").select("msg_id", r6(score("text")).alias("score"))


@query(None)
def k2_text_embedder(view, table):
    embed = hooks.text_embedder(hooks.hashed_counts(16))
    return view("v_message").select("msg_id", F.transform(embed("text"), lambda x: F.round(x, 4)).alias("vector"))


@query("SELECT asset, round(sum(sentiment * impact) / sum(impact), 6) + 0.0 AS weighted, count(DISTINCT category) AS kinds FROM v_signal GROUP BY 1")
def k3_k4_group_functions(view, table):
    from tidemark.operators.buckets import weighted_avg

    return view("v_signal").groupBy("asset").agg(r6(weighted_avg("sentiment", "impact")).alias("weighted"), F.count_distinct("category").alias("kinds"))


@query("SELECT event_id, count(*) AS pairs FROM (SELECT a.event_id FROM (SELECT DISTINCT event_id, entity FROM v_mention) a JOIN (SELECT DISTINCT event_id, entity FROM v_mention) b ON a.event_id = b.event_id AND a.entity < b.entity) GROUP BY 1")
def k5_pair_rows(view, table):
    names = view("v_mention").groupBy("event_id").agg(F.array_sort(F.collect_set("entity")).alias("names"))
    pairs = names.select("event_id", F.explode(G.pairs_of("names")).alias("p"))
    return pairs.groupBy("event_id").agg(F.count("p").alias("pairs"))


@query("WITH o AS (SELECT DISTINCT event_id, entity FROM v_mention) SELECT a.entity AS src, b.entity AS dst, count(*) AS n FROM o a JOIN o b ON a.event_id = b.event_id AND a.entity < b.entity GROUP BY 1, 2")
def k5_pairs_table_function(view, table):
    """Pairs of each event by a table function in SQL, with the event as its partition."""
    m = view("v_mention").select("event_id", "entity")
    spark = m.sparkSession
    G.register_table_functions(spark)
    m.createOrReplaceTempView("tidemark_mentions")
    return spark.sql("SELECT src, dst, count(*) AS n FROM entity_pairs(TABLE(tidemark_mentions) PARTITION BY event_id) GROUP BY src, dst")
