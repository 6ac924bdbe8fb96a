"""Queries of parsing, cleaning, deduplication and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import annotations as A
from tidemark.functions import text as T
from tidemark.operators import dedup as C
from tidemark.operators import stats as I
from tidemark.plans.registry import query, r6
from tidemark.sources import io


@query("SELECT sec, s AS key, round(value + 1, 6) AS value FROM v_signal, (SELECT unnest(['x', 'y']) AS s) WHERE s = 'x' UNION ALL SELECT sec, 'y', round(k / 10.0, 6) FROM v_signal")
def a4_explode_metric_docs(view, table):
    doc = F.to_json(F.struct(F.col("sec").alias("date"), F.create_map(F.lit("x"), F.col("value") + 1, F.lit("y"), F.col("k") / 10.0).alias("prices")))
    return io.explode_metric_docs(view("v_signal").select(doc.alias("doc"))).withColumn("value", r6("value"))


@query("SELECT msg_id, 'msg-' || msg_id AS custom_id, 2 AS n_messages, substr(text, 1, 1200) AS content FROM v_message")
def a6_request_rows(view, table):
    rows = io.to_request_rows(view("v_message"), "m", "annotate")
    return rows.select("msg_id", F.get_json_object("line", "$.custom_id").alias("custom_id"), F.size(F.from_json(F.get_json_object("line", "$.body.messages"), "array<string>")).alias("n_messages"), F.get_json_object("line", "$.body.messages[1].content").alias("content"))


@query("SELECT msg_id, length(text) AS n FROM v_message WHERE (contains(lower(text), 'license') OR contains(lower(text), 'idiot')) AND length(text) >= 30")
def b1_keyword_filter(view, table):
    return T.keyword_filter(view("v_message"), ["License", "idiot"]).select("msg_id", F.length("text").alias("n"))


@query("SELECT msg_id, substr(text, 1, 512) AS t512, substr(text, 1, 300) AS t300 FROM v_message")
def b2_truncate(view, table):
    return view("v_message").select("msg_id", T.truncate("text", 512).alias("t512"), T.truncate("text", 300).alias("t300"))


@query("SELECT msg_id, '{\"k\": ' || k || '}' AS content FROM v_signal")
def b3_strip_fence(view, table):
    obj = F.concat(F.lit('{"k": '), F.col("k"), F.lit("}"))
    fenced = F.when(F.col("k") % 3 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit("```\n"), obj, F.lit("\n``` done"))).otherwise(F.concat(F.lit("  "), obj, F.lit("\n")))
    return view("v_signal").select("msg_id", T.strip_fence(fenced).alias("content"))


def _responses(view):
    """Response lines of events, broken in fixed ways."""
    target = F.struct(
        F.concat(F.lit("T"), F.col("k")).alias("name"), F.lit("TK").alias("ticker"), F.when(F.col("k") % 17 == 0, "PLANET").otherwise("CRYPTO").alias("type"),
        F.col("sentiment").cast("int").alias("sentiment"), F.when(F.col("k") % 19 == 0, 12).otherwise(F.col("impact").cast("int")).alias("impact"), F.col("category").alias("category"),
    )
    full = F.to_json(F.struct(F.array(target).alias("targets"), F.col("sentiment").cast("int").alias("global_sentiment"), (F.col("k") % 2 == 0).alias("is_fact")))
    bare = F.to_json(F.struct(F.array(target).alias("targets")))
    m = F.col("msg_id")
    content = F.when(m % 11 == 0, F.substring(full, 1, 40)).when(m % 13 == 0, bare).when(m % 7 == 0, F.concat(F.lit("{broken"), full)).otherwise(F.concat(F.lit("```json\n"), full, F.lit("\n```")))
    finish = F.when(m % 17 == 0, "length").otherwise("stop")
    usage = F.struct((F.col("k") + 100).alias("prompt_tokens"), F.col("k").alias("completion_tokens"), (2 * F.col("k") + 100).alias("total_tokens"))
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"), finish.alias("finish_reason"))).alias("choices"), usage.alias("usage"))
    line = F.to_json(F.struct(F.concat(F.lit("msg-"), m).alias("custom_id"), F.when(m % 23 == 0, "rate limit").alias("error"), F.struct(body.alias("body")).alias("response")))
    return view("v_signal").select(line.alias("value"))


_STATUS = "CASE WHEN msg_id % 23 = 0 THEN 'api_error' WHEN msg_id % 17 = 0 THEN 'truncated' WHEN msg_id % 11 = 0 THEN 'unterminated_json' WHEN msg_id % 13 = 0 THEN 'missing_fields' WHEN msg_id % 7 = 0 THEN 'json_decode_error' ELSE 'ok' END"


@query(f"SELECT msg_id, {_STATUS} AS status FROM v_signal")
def b4_b6_parse_annotations(view, table):
    return A.classify_annotations(_responses(view)).select(T.parse_msg_id("custom_id").alias("msg_id"), "status")


@query(f"SELECT msg_id, k % 17 <> 0 AND k % 19 <> 0 AS valid, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 0 END AS first_bad, 'T' || k AS names, 1 AS num_targets, false AS has_conflict, CASE WHEN k % 19 = 0 THEN 12.0 ELSE impact END AS avg_impact, CASE WHEN k % 17 = 0 THEN 'PLANET' ELSE 'CRYPTO' END AS types FROM v_signal WHERE {_STATUS} = 'ok'")
def b5_b11_b12_validate(view, table):
    ok, _ = A.parse_annotations(_responses(view))
    out = T.target_metrics(A.validate_annotations(ok))
    return out.select(T.parse_msg_id("custom_id").alias("msg_id"), "valid", F.col("first_bad").cast("int").alias("first_bad"), T.target_names("targets").alias("names"), "num_targets", "has_conflict", "avg_impact", "types")


@query("SELECT msg_id, CASE WHEN k % 4 IN (0, 3) THEN 1 ELSE 0 END AS n, CASE WHEN k % 4 IN (0, 3) THEN 'n' || k END AS name FROM v_signal")
def b7_b8_parse_targets(view, table):
    good = F.concat(F.lit('[{"name": "n'), F.col("k"), F.lit('", "ticker": ""}]'))
    quoted = F.concat(F.lit('"'), F.regexp_replace(good, '"', '""'), F.lit('"'))
    raw = F.when(F.col("k") % 4 == 0, good).when(F.col("k") % 4 == 1, "").when(F.col("k") % 4 == 2, '{"name": 1}').otherwise(quoted)
    t = T.parse_targets(T.repair_csv_json(raw))
    return view("v_signal").select("msg_id", F.size(F.filter(t, lambda x: x["name"].startswith("n"))).alias("n"), F.when(F.col("k") % 4 != 2, F.get(t, F.lit(0))["name"]).alias("name"))


@query("SELECT msg_id, CAST(CASE k % 5 WHEN 0 THEN k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS DOUBLE) AS sentiment FROM v_signal")
def b9_normalize_sentiment(view, table):
    raw = F.when(F.col("k") % 5 == 0, F.col("k").cast("string")).when(F.col("k") % 5 == 1, " Positive").when(F.col("k") % 5 == 2, "negative").when(F.col("k") % 5 == 3, "neutral")
    return view("v_signal").select("msg_id", T.normalize_sentiment(raw).alias("sentiment"))


@query("""SELECT msg_id, CAST(extract(hour FROM ts) AS INT) AS "hour", CAST(isodow(ts) - 1 AS INT) AS day_of_week, isodow(ts) >= 6 AS weekend, CAST(year(ts) AS INT) AS "year", CAST(quarter(ts) AS INT) AS "quarter", CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start FROM v_signal""")
def b13_b14_calendar(view, table):
    hour = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', h)")
    return view("v_signal").withColumn("h", T.utc_hour("ts").cast("timestamp_ntz")).select("msg_id", *[c.alias(n) for n, c in T.calendar_features("ts").items()], hour.alias("hour_start"))


@query("SELECT msg_id, round(ln(value), 6) + 0.0 AS log_value, round(ln(1 + value), 6) AS log1p_value, CASE WHEN abs(sentiment * k / 100) >= 0.5 THEN 'large' WHEN abs(sentiment * k / 100) >= 0.3 THEN 'medium' WHEN abs(sentiment * k / 100) >= 0.1 THEN 'small' ELSE 'negligible' END AS label FROM v_signal")
def b15_b16_log_and_effect(view, table):
    return view("v_signal").withColumns(T.log_features(["value"])).select("msg_id", r6("log_value").alias("log_value"), r6("log1p_value").alias("log1p_value"), T.effect_label(F.col("sentiment") * F.col("k") / 100).alias("label"))


@query("SELECT msg_id, CASE WHEN abs(sentiment * k / 100) > 0.5 THEN 'Strong' WHEN abs(sentiment * k / 100) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength, k IS NOT NULL AND k / 1000.0 < 0.05 AS significant FROM v_signal")
def b16_strength_and_significance(view, table):
    return view("v_signal").select("msg_id", T.strength_label(F.col("sentiment") * F.col("k") / 100).alias("strength"), T.significant(F.col("k") / 1000.0).alias("significant"))


@query("SELECT msg_id AS m_msg_id, k AS m_k FROM v_signal WHERE k % 10 NOT IN (0, 1)")
def b17_b18_drop_incomplete(view, table):
    x = F.when(F.col("k") % 10 == 0, F.lit(None)).when(F.col("k") % 10 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return T.with_prefix(T.drop_incomplete(view("v_signal").withColumn("x", x), ["x", "k"]).select("msg_id", "k"), "m_")


@query("SELECT d.day, n_off, round(mean_deviation, 6) AS mean_deviation, round(max_deviation, 6) AS max_deviation FROM (SELECT day, avg(abs(value / 250 - 1)) AS mean_deviation, max(abs(value / 250 - 1)) AS max_deviation FROM v_signal GROUP BY 1) d JOIN (SELECT day, count(*) AS n_off FROM v_signal WHERE value / 250 < 0.95 OR value / 250 > 1.05 GROUP BY 1) e ON d.day = e.day")
def b19_b20_depeg(view, table):
    p = view("v_signal").withColumn("price", F.col("value") / 250)
    off = T.depeg_events(p).groupBy("day").agg(F.count("deviation").alias("n_off"))
    return T.depeg_scores(p).join(off, "day").select("day", "n_off", r6("mean_deviation").alias("mean_deviation"), r6("max_deviation").alias("max_deviation"))


@query("SELECT msg_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY day, msg_id) AS n FROM v_message) WHERE n = 1")
def c1_dedup_keep_first(view, table):
    return C.dedup_keep(view("v_message"), ["text"], ["day", "msg_id"]).select("msg_id", "channel")


_ASSETS = [("alpha", ["TK1"], ["name 2"]), ("beta", ["TK2", "TK3"], ["zzz"])]


@query("""WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS i, l_partkey, impact, sentiment, category FROM (SELECT event_id, l_partkey, category, impact, sentiment, min(pos) AS pos FROM v_mention GROUP BY ALL)),
f AS (SELECT 'alpha' AS asset, * FROM t WHERE l_partkey % 4 = 1 OR contains('name ' || l_partkey % 30, 'name 2') UNION ALL SELECT 'beta', * FROM t WHERE l_partkey % 4 IN (2, 3))
SELECT asset, event_id AS msg_id, max(impact) AS impact, count(*) > 0 AS found FROM f GROUP BY 1, 2""")
def c2_select_asset_target(view, table):
    t = F.struct(F.concat(F.lit("Name "), F.col("l_partkey") % 30).alias("name"), F.concat(F.lit("tk"), F.col("l_partkey") % 4).alias("ticker"), F.col("impact"), F.col("sentiment"), F.col("category"))
    msgs = view("v_mention").groupBy(F.col("event_id").alias("msg_id")).agg(F.collect_list(t).alias("targets"))
    assets = msgs.sparkSession.createDataFrame(_ASSETS, "asset string, tickers array<string>, aliases array<string>")
    return C.select_asset_target(msgs, assets).select("asset", "msg_id", "impact", F.lit(True).alias("found"))


@query("""WITH a AS (SELECT range AS id, lower('e' || (range % 60) || CASE WHEN range % 2 = 0 THEN '' ELSE '.' || range END) AS alias FROM range(2000))
SELECT entity, count(DISTINCT id) AS hits FROM (SELECT DISTINCT entity FROM v_mention) m JOIN a ON contains(lower(entity), alias) GROUP BY 1""")
def c2_many_aliases(view, table):
    """2,000 aliases looked up in one pass over each name."""
    aliases = [(i, f"e{i % 60}" + ("" if i % 2 == 0 else f".{i}")) for i in range(2000)]
    names = view("v_mention").select("entity").distinct()
    return C.alias_hits(names, "entity", aliases).where(F.size("hits") > 0).select("entity", F.size("hits").cast("bigint").alias("hits"))


@query("SELECT msg_id FROM v_message WHERE text NOT IN (SELECT text FROM v_message WHERE msg_id % 3 = 0)")
def c3_anti_unprocessed(view, table):
    m = view("v_message")
    return C.anti_unprocessed(m, m.where("msg_id % 3 = 0").select("text")).select("msg_id")


@query("SELECT asset, hr, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY asset, hr ORDER BY sec DESC, msg_id DESC) AS n FROM v_signal) WHERE n = 1")
def c4_dedup_keep_last(view, table):
    return C.dedup_keep(view("v_signal"), ["asset", "hr"], ["sec", "msg_id"], "last").select("asset", "hr", "msg_id")


@query("SELECT msg_id, CAST(least(floor((row_number() OVER (ORDER BY msg_id) - 1) / (SELECT floor(count(*) / 7) FROM v_message)), 6) AS INT) AS batch FROM v_message")
def c5_assign_batches(view, table):
    return C.assign_batches(view("v_message").select("msg_id"), 7, "msg_id")


@query("SELECT msg_id, CASE WHEN msg_id % 5 = 0 THEN CASE WHEN msg_id % 10 = 0 THEN NULL ELSE 'new' END ELSE channel END AS channel FROM v_message")
def c6_c7_merge_annotations(view, table):
    m = view("v_message").select("msg_id", "channel")
    retry = C.union_results(m.where("msg_id % 10 = 0").select("msg_id"), m.where("msg_id % 10 = 5").select("msg_id", F.lit("new").alias("channel")))
    return C.merge_annotations(m, retry, "msg_id", ["channel"])


@query("SELECT count(*) FILTER (WHERE a) AS in_a, count(*) FILTER (WHERE b) AS in_b, count(*) FILTER (WHERE a AND b) AS in_both, count(*) AS in_either FROM (SELECT text, bool_or(msg_id % 2 = 0) AS a, bool_or(msg_id % 2 = 1) AS b FROM v_message GROUP BY 1)")
def c8_corpus_overlap(view, table):
    m = view("v_message")
    return C.corpus_overlap(m.where("msg_id % 2 = 0"), m.where("msg_id % 2 = 1"))


@query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS different, least(50, count(*)) AS known FROM v_message")
def c9_sample_size(view, table):
    """A sample has its size, no row twice, and only rows that are there."""
    m = view("v_message").select("msg_id", "channel")
    picked = C.sample_n(m, 50, 7, "msg_id").join(m.select("msg_id", F.lit(1).alias("there")), "msg_id", "left")
    return picked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("msg_id").alias("different"), F.count("there").alias("known"))


@query(None)
def c9_sample_n(view, table):
    return C.sample_n(view("v_message").select("msg_id", "channel"), 50, 7, "msg_id")


@query(f"SELECT msg_id, asset, {_STATUS} AS status FROM v_signal WHERE {_STATUS} <> 'ok'")
def c10_failed_rows(view, table):
    _, failed = A.parse_annotations(_responses(view))
    errors = failed.select(T.parse_msg_id("custom_id").alias("msg_id"), "status")
    return C.failed_rows(view("v_signal").select("msg_id", "asset"), errors, "msg_id", "status")


@query("SELECT event_id, entity, impact FROM (SELECT *, row_number() OVER (PARTITION BY event_id, entity ORDER BY pos DESC, l_partkey DESC, impact DESC) AS n FROM v_mention) WHERE n = 1")
def c11_merge_mentions(view, table):
    return C.merge_mentions(view("v_mention"), ["event_id", "entity"], ["pos", "l_partkey", "impact"]).select("event_id", "entity", "impact")


@query("(SELECT 'top' AS part, msg_id, value FROM v_signal ORDER BY value DESC, msg_id LIMIT 20) UNION ALL (SELECT 'bottom', msg_id, value FROM v_signal ORDER BY value, msg_id LIMIT 20)")
def g1_g2_topk(view, table):
    s = view("v_signal")
    parts = [C.global_top(s, "value", 20, "msg_id", p == "bottom").select(F.lit(p).alias("part"), "msg_id", "value") for p in ("top", "bottom")]
    return parts[0].unionByName(parts[1])


@query("WITH c AS (SELECT day, entity, count(*) AS n FROM v_mention GROUP BY 1, 2) SELECT day, entity, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, entity) AS r FROM c) WHERE r <= 3")
def g3_topk_by(view, table):
    return C.top_by(view("v_mention").groupBy("day", "entity").agg(F.count(F.lit(1)).alias("n")), ["day"], "n", 3, "entity")


@query("SELECT asset, hr, msg_id, value FROM (SELECT *, row_number() OVER (PARTITION BY asset, hr ORDER BY value DESC, msg_id) AS n FROM v_signal) WHERE n = 1")
def g4_argmax(view, table):
    return C.argmax(view("v_signal"), ["asset", "hr"], "value", "msg_id", ["msg_id", "value"])


@query("SELECT CASE WHEN category = 'error' THEN 'INVALID' ELSE CASE WHEN category = 'click' THEN 'PRESS' ELSE upper(category) END END AS category, count(*) AS n FROM v_signal GROUP BY 1")
def m9_normalize_category(view, table):
    c = T.normalize_category("category", ["SIGNUP", "PRESS", "VIEW", "PURCHASE"], {"CLICK": "PRESS"})
    return view("v_signal").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT channel AS source, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_signal), 6) AS share FROM v_signal GROUP BY 1")
def m10_source_concentration(view, table):
    return C.concentration(view("v_signal"), "channel").withColumn("share", r6("share"))


@query("""WITH s AS (SELECT DISTINCT asset, channel FROM v_signal), c AS (SELECT asset, channel, count(*) AS n FROM v_signal GROUP BY 1, 2),
d AS (SELECT asset, channel, row_number() OVER (PARTITION BY asset ORDER BY n DESC, channel) = 1 AS dominant, n / sum(n) OVER (PARTITION BY asset) AS share FROM c)
SELECT s.asset, s.channel, round(any_value(share), 6) AS share, any_value(dominant) AS dominant, count(*) AS n, round(corr(k, value), 6) + 0.0 AS r, round(regr_slope(value, k), 6) + 0.0 AS slope
FROM s JOIN v_signal v ON v.asset = s.asset AND v.channel <> s.channel JOIN d ON d.asset = s.asset AND d.channel = s.channel GROUP BY 1, 2""")
def m10_without_each_source(view, table):
    """Correlation and slope of each asset without each of its channels, the dominant one marked."""
    long = view("v_signal").select("asset", "channel", F.col("k").cast("double").alias("x"), F.col("value").alias("y"))
    return I.without_each_source(long, ["asset"], "channel").withColumns({c: r6(c) for c in ("share", "r", "slope")})
