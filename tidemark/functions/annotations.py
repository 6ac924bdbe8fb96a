"""Annotation responses: classify, parse, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import TARGETS, TYPES, strip_fence

RESPONSE = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>,finish_reason:string>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>>"
CONTENT = f"targets {TARGETS.simpleString()}, global_sentiment int, is_fact boolean, _corrupt string"
REQUIRED = ("targets", "global_sentiment", "is_fact")


def classify_annotations(lines: DataFrame, line: str = "value") -> DataFrame:
    """Response lines, parsed once: custom_id, status, usage, the annotation's fields, and the line. status is ok or the first
    class that fits: api_error, truncated, unterminated_json, json_decode_error, missing_fields; a line that is no JSON
    object itself is unknown."""
    # a generator of one row keeps the optimizer from repeating a parse wherever its result is used
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    choice = F.get(F.col("r.response.body.choices"), F.lit(0))
    rows = lines.select(line, once(F.from_json(F.col(line), RESPONSE), "r"))
    rows = rows.select(line, "r.custom_id", "r.error", F.col("r.response.body.usage").alias("usage"), choice["finish_reason"].alias("finish"), once(strip_fence(choice["message"]["content"]), "content"))
    rows = rows.select("*", once(F.from_json("content", CONTENT, {"columnNameOfCorruptRecord": "_corrupt"}), "doc"))
    missing = F.lit(False)
    for f in REQUIRED:
        missing = missing | F.col(f"doc.{f}").isNull()
    status = (
        F.when(F.col("custom_id").isNull(), "unknown").when(F.col("error").isNotNull(), "api_error").when(F.col("finish") == "length", "truncated")
        .when(F.col("content").isNull(), "unknown").when(~F.col("content").endswith("}"), "unterminated_json")
        .when(F.col("doc._corrupt").isNotNull(), "json_decode_error").when(missing, "missing_fields").otherwise("ok")
    )
    return rows.select("custom_id", status.alias("status"), "usage", *[F.col(f"doc.{f}").alias(f) for f in REQUIRED], line)


def parse_annotations(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """``classify_annotations`` as two tables, the parsed rows and the failed ones. Each is a pass of its own over the lines."""
    rows = classify_annotations(lines, line)
    return rows.where("status = 'ok'").drop("status", line), rows.where("status <> 'ok'").select("custom_id", "status", line)


def bad_target(t: Column) -> Column:
    return ~F.coalesce(
        t["name"].isNotNull() & t["sentiment"].isin(-1, 0, 1) & t["impact"].between(1, 10) & t["type"].isin(*TYPES), F.lit(False)
    )


def validate_annotations(df: DataFrame, targets: str = "targets") -> DataFrame:
    """Add valid, and first_bad: the index of the first target that breaks the contract (null if none)."""
    flags = F.transform(F.col(targets), bad_target)
    at = F.array_position(flags, True)
    return df.withColumns({"valid": F.col(targets).isNotNull() & (F.coalesce(at, F.lit(1)) == 0), "first_bad": F.when(at > 0, at - 1)})
