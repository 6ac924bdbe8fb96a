"""Findings F8 to F15 of round 3: the queries of windowed graphs keep an event's rows in the parts that v_mention is dealt into."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"
NAMES = ("h11_windowed_communities", "h12_windowed_modularity", "h13_assortativity", "h15_centralization", "h3_windowed_cooccurrence", "h4_graph_basics", "h5_hub_degrees", "h7_gini")


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", NAMES)
def test_events_of_windowed_graphs_stay_in_dealt_parts(spark, monkeypatch, name):
    def stop(m, day, days):
        raise Seen(m)

    monkeypatch.setattr(fixtures, "ROWS", 500)
    monkeypatch.setattr(G, "windowed_cooccurrence", stop)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, SF)
    m = seen.value.args[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        pairs = G.event_pairs(m, carry=["day"])
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # neither the join nor the pairs are dealt anew
        sizes = [r["count"] for r in m.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) > 5000 and max(sizes) < 1000
