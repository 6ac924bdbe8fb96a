"""Queries of readers and writers: what is written to the shared folder comes back as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup as C
from tidemark.operators import graph as G
from tidemark.plans.registry import query, r6
from tidemark.scratch import scratch_dir
from tidemark.sources import io


@query("SELECT channel, views, 0 AS forwards, length(text) AS n, md5(text) AS text FROM v_message WHERE length(text) >= 30")
def a1_read_messages(view, table):
    """Files of one JSON array each, 500 messages in a file, in a folder for each channel."""
    m = view("v_message")
    base = scratch_dir(m.sparkSession)
    row = F.struct(F.lit("2024-01-01T00:00:00").alias("date"), "channel", "text", "views")
    files = m.groupBy("channel", F.floor(F.col("msg_id") / 500).alias("batch")).agg(F.to_json(F.collect_list(row)).alias("value"))
    files.write.partitionBy("channel", "batch").text(base)
    return io.read_messages(m.sparkSession, f"{base}/*/*/part-*", least=30).select("channel", "views", "forwards", F.length("text").alias("n"), F.md5("text").alias("text"))


@query("SELECT symbol, day, round(close, 4) AS close, round(volume, 4) AS volume FROM v_bars")
def a2_read_table_csv(view, table):
    bars = view("v_bars").select("symbol", "day", "close", "volume")
    path = scratch_dir(bars.sparkSession)
    io.write_csv(bars, path)
    return io.read_table_csv(bars.sparkSession, path, bars.schema).withColumns({"close": r6("close", 4), "volume": r6("volume", 4)})


@query("SELECT msg_id FROM v_signal")
def a3_read_jsonl(view, table):
    lines = view("v_signal").select(F.explode(F.array(F.to_json(F.struct("msg_id", "asset")), F.when(F.col("k") % 5 == 0, "  ").otherwise(""))).alias("value"))
    path = scratch_dir(lines.sparkSession)
    lines.write.text(path)
    return io.read_jsonl(lines.sparkSession, path).select(F.get_json_object("value", "$.msg_id").cast("bigint").alias("msg_id"))


@query("SELECT page_id, md5(url) AS url, md5(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS html FROM pages")
def a5_write_csv(view, table):
    """Markup with quotes, commas and line ends through a file; line ends come back as one kind."""
    pages = table("pages").select("page_id", "url", "html")
    path = scratch_dir(pages.sparkSession)
    io.write_csv(pages.limit(0), path)
    io.write_csv(pages, path)  # takes the place of what is there
    same = F.replace(F.replace("html", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return io.read_table_csv(pages.sparkSession, path, pages.schema).select("page_id", F.md5("url").alias("url"), F.md5(same).alias("html"))


@query("SELECT asset, count(*) AS rows_, 1 AS run FROM v_signal GROUP BY 1 UNION ALL SELECT asset, count(*), 2 FROM v_signal GROUP BY 1")
def a7_append_run(view, table):
    runs = view("v_signal").groupBy("asset").agg(F.count(F.lit(1)).alias("rows_"))
    path = scratch_dir(runs.sparkSession)
    for k in (1, 2):
        io.append_run(runs.withColumn("run", F.lit(k)), path)
    return runs.sparkSession.read.schema("asset string, rows_ bigint, run int").json(path)


@query("""WITH one AS (SELECT DISTINCT event_id, entity FROM v_mention), e AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM one a JOIN one b ON a.event_id = b.event_id AND a.entity < b.entity GROUP BY 1, 2)
SELECT 'vertex' AS kind, entity AS src, NULL AS dst, count(*) AS weight FROM one GROUP BY 2 UNION ALL SELECT 'edge', src, dst, weight FROM e""")
def a8_export_graph(view, table):
    one = C.merge_mentions(view("v_mention"), ["event_id", "entity"], ["pos", "l_partkey", "impact", "sentiment"])
    path = scratch_dir(one.sparkSession)
    io.export_graph(one.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions")), G.cooccurrence(one, 1), path)
    read = one.sparkSession.read.parquet
    vertices = read(f"{path}/vertices").select(F.lit("vertex").alias("kind"), F.col("entity").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("mentions").alias("weight"))
    return vertices.unionByName(read(f"{path}/edges").select(F.lit("edge").alias("kind"), "src", "dst", "weight"))


@query("SELECT msg_id, CASE WHEN k % 3 = 0 THEN 0.0 ELSE sentiment END AS sentiment, CASE WHEN k % 4 < 2 THEN 1.0 ELSE impact END AS impact, CASE WHEN k % 5 = 0 THEN 'UNKNOWN' ELSE asset END AS category FROM v_signal")
def b10_defaults(view, table):
    """Missing sentiment counts 0, missing or zero impact 1, a missing category is UNKNOWN."""
    k = F.col("k")
    target = F.struct(
        F.lit("Coin").alias("name"), F.lit("cn").alias("ticker"), F.when(k % 3 != 0, F.col("sentiment")).alias("sentiment"),
        F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 != 1, F.col("impact")).alias("impact"), F.when(k % 5 != 0, F.col("asset")).alias("category"),
    )
    messages = view("v_signal").select("msg_id", F.array(target).alias("targets"))
    assets = messages.sparkSession.createDataFrame([("coin", ["CN"], ["coin"])], "asset string, tickers array<string>, aliases array<string>")
    return C.select_asset_target(messages, assets).select("msg_id", "sentiment", "impact", "category")
