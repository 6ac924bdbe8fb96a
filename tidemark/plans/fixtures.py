"""Domain views over the driver's tables, written once in SQL that Spark and the oracle share but for a few words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.scratch import shuffle_partitions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_signal": """
SELECT event_id AS msg_id, concat('a', CAST(user_id % 3 AS STRING)) AS asset, ts, SEC(ts) AS sec,
       CAST(floor(SEC(ts) / 3600) AS BIGINT) AS hr, CAST(floor(SEC(ts) / 86400) AS BIGINT) AS day,
       concat('ch', CAST(user_id % 7 AS STRING)) AS channel, user_id, value, event_type AS category,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
       CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 3 - 1 AS DOUBLE) AS sentiment,
       CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 10 + 1 AS DOUBLE) AS impact,
       CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 7 = 0 THEN NULL
            ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 2 = 0 END AS is_fact,
       CAST(floor(value) AS BIGINT) AS views, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 5 AS forwards
FROM events""",
    "v_bars": """
SELECT l_returnflag AS symbol, CAST(floor(SEC(l_shipdate) / 86400) AS BIGINT) AS day,
       MINBY(l_extendedprice; l_orderkey * 10 + l_linenumber) AS open, MAXBY(l_extendedprice; l_orderkey * 10 + l_linenumber) AS close,
       max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2""",
    "v_bars_hourly": """
SELECT concat('a', CAST(user_id % 3 AS STRING)) AS symbol, CAST(floor(SEC(ts) / 3600) AS BIGINT) AS hr,
       MINBY(value; event_id) AS open, MAXBY(value; event_id) AS close, max(value) AS high, min(value) AS low,
       CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2""",
    "v_mention": """
SELECT o_orderkey AS event_id, CAST(floor(SEC(o_orderdate) / 86400) AS BIGINT) AS day,
       l_orderkey * 10 + l_linenumber AS pos, l_partkey, concat('e', CAST(l_partkey % 50 AS STRING)) AS entity,
       CAST(CASE WHEN l_discount < 0.035 THEN -1 WHEN l_discount > 0.065 THEN 1 ELSE 0 END AS BIGINT) AS sentiment,
       CAST(floor(l_quantity) AS BIGINT) % 10 + 1 AS impact, l_returnflag AS category, l_linestatus AS type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_message": """
SELECT doc_id AS msg_id, source AS channel, text, doc_id % 60 AS day, n_chars AS views FROM documents""",
}

#: Tables that a view joins by key, with that key; both are dealt by it into parts of about ``ROWS`` rows of the longer one.
JOINED = {"v_mention": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
ROWS = 250_000


def _words(sql: str, sec: str, least: str, most: str) -> str:
    sql = re.sub(r"SEC\((\w+)\)", sec, sql)
    sql = re.sub(r"MINBY\(([^;]+); ([^)]+)\)", least, sql)
    return re.sub(r"MAXBY\(([^;]+); ([^)]+)\)", most, sql)


def spark_sql(sql: str) -> str:
    return _words(sql, r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", r"min_by(\1, struct(\2, \1))", r"max_by(\1, struct(\2, \1))")


def oracle(sql: str) -> str:
    """Oracle SQL with the views it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = [f"{v} AS ({_words(VIEWS[v], r'CAST(floor(epoch(\1)) AS BIGINT)', r"arg_min(\1, {'k': \2, 'x': \1})", r"arg_max(\1, {'k': \2, 'x': \1})")})" for v in used]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join([*views, body[len(head) :].strip()])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Parts that the tables of a joined view are dealt into, so that a task's memory does not grow with them; 0 leaves short
    tables to the session. Parquet keeps the number of rows in its footers."""
    rows = max((table(spark, sf_dir, t).count() for t in JOINED.get(name, ())), default=0)
    return max(shuffle_partitions(spark), -(-rows // ROWS)) if rows > ROWS else 0


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables of ``sf_dir``."""
    n = parts(spark, sf_dir, name)

    def source(t: str) -> str:
        path = f"parquet.`{sf_dir}/{t}.parquet`"
        return f"(SELECT /*+ REPARTITION({n}, {JOINED[name][t]}) */ * FROM {path})" if n else path

    sql = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {source(m[2])}" if m[2] in TABLES else m[0], spark_sql(VIEWS[name]))
    return spark.sql(sql)
