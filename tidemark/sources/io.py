"""Readers and writers of message, response, bar and graph files. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import truncate

MESSAGE = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("views", T.LongType()), T.StructField("forwards", T.LongType()), T.StructField("replies", T.LongType()),
])


def read_messages(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Messages of files that hold one JSON array each, ``path`` being a glob; missing counters are 0; file tells where from."""
    raw = spark.read.schema(MESSAGE).option("multiLine", True).json(path)
    counters = {c: F.coalesce(c, F.lit(0)) for c in ("views", "forwards", "replies")}
    out = raw.withColumn("file", F.col("_metadata.file_name")).withColumns(counters).withColumn("date", F.to_timestamp("date"))
    return out.where(F.length(F.coalesce("text", F.lit(""))) >= least)


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text, blanks left out; parsing is left to ``parse_annotations``, which keeps bad lines."""
    return spark.read.text(path).where("trim(value) <> ''")


def explode_metric_docs(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents {date, prices: {key: value}} with epoch seconds to rows (sec, key, value)."""
    parsed = F.from_json(F.col(doc), "date bigint, prices map<string,double>")
    return df.select(parsed.alias("d")).select(F.col("d.date").alias("sec"), F.explode("d.prices").alias("key", "value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def to_request_rows(df: DataFrame, model: str, prompt: str, chars: int = 1200, key: str = "msg_id", text: str = "text") -> DataFrame:
    """(key, line): one nested request for each message, its text cut to ``chars``."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.array(message("system", F.lit(prompt)), message("user", truncate(text, chars))).alias("messages"),
        F.lit(0.0).alias("temperature"), F.lit(1000).alias("max_tokens"),
    )
    line = F.to_json(F.struct(F.concat(F.lit("msg-"), F.col(key)).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return df.select(key, line.alias("line"))


def write_requests(rows: DataFrame, path: str, batch: str = "batch") -> None:
    rows.select(batch, F.col("line").alias("value")).write.mode("overwrite").partitionBy(batch).text(path)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
