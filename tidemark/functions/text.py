"""Column functions for message texts, annotation JSON, dates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("sentiment", T.IntegerType()), T.StructField("impact", T.IntegerType()), T.StructField("category", T.StringType()),
])
TARGETS = T.ArrayType(TARGET)
#: Kinds of target, and the categories that a message may be filed under.
TYPES = ("CRYPTO", "COMPANY", "PERSON", "COUNTRY", "OTHER")
CATEGORIES = {"TECHNOLOGY": "TECHNICAL"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_filter(df: DataFrame, keywords: Sequence[str], least: int = 30, text: str = "text") -> DataFrame:
    """Texts of at least ``least`` characters that contain any keyword, in whatever case."""
    low, any_of = F.lower(text), F.lit(False)
    for k in keywords:
        any_of = any_of | low.contains(k.lower())
    return df.where(any_of & (F.length(text) >= least))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def strip_fence(c: Column | str) -> Column:
    """The JSON object in a Markdown code fence; the stripped text itself where no part begins with a brace."""
    c = strip(c)
    parts = F.transform(F.split(c, "```"), lambda p: F.regexp_replace(strip(p), r"^json\s*", ""))
    return F.coalesce(F.when(c.startswith("```"), F.get(F.filter(parts, lambda p: p.startswith("{")), F.lit(0))), c)


def parse_msg_id(c: Column | str) -> Column:
    """The number of a request key ``msg-<n>``, null if there is none."""
    return F.try_element_at(F.split(_c(c), "-"), F.lit(2)).try_cast("bigint")


def parse_targets(c: Column | str) -> Column:
    """Targets of a JSON array; an empty array for anything else."""
    return F.coalesce(F.from_json(F.trim(_c(c)), TARGETS), F.array().cast(TARGETS))


def repair_csv_json(c: Column | str) -> Column:
    """JSON as it was before CSV quoting; only what doesn't parse as it is gets changed."""
    c = _c(c)
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return F.when(F.try_parse_json(c).isNotNull() & ~F.trim(c).startswith('"'), c).otherwise(bare)


def normalize_sentiment(c: Column | str) -> Column:
    """Numbers pass, positive and negative become 1 and -1, all else 0."""
    word = F.lower(F.trim(_c(c)))
    return F.coalesce(word.try_cast("double"), F.when(word == "positive", 1.0).when(word == "negative", -1.0).otherwise(0.0))


def target_names(targets: Column | str) -> Column:
    """Names joined by |, null for none."""
    return F.nullif(F.array_join(F.transform(_c(targets), lambda t: t["name"]), "|"), F.lit(""))


def target_metrics(df: DataFrame, targets: str = "targets") -> DataFrame:
    """num_targets, has_conflict (more than one sentiment), avg_impact, types (distinct, sorted, joined)."""
    t = F.col(targets)
    total = F.aggregate(t, F.lit(0.0), lambda a, x: a + F.coalesce(x["impact"], F.lit(0)))
    return df.withColumns({
        "num_targets": F.size(t), "has_conflict": F.size(F.array_distinct(F.transform(t, lambda x: x["sentiment"]))) > 1,
        "avg_impact": F.coalesce(total / F.nullif(F.size(t), F.lit(0)), F.lit(0.0)),
        "types": F.array_join(F.array_sort(F.array_distinct(F.transform(t, lambda x: x["type"]))), ","),
    })


def utc_hour(c: Column | str, zone: str | None = None) -> Column:
    """Hour that a timestamp falls in; local times of ``zone`` are converted to UTC first."""
    c = _c(c)
    return F.date_trunc("hour", F.to_utc_timestamp(c, zone) if zone else c)


def calendar_features(ts: Column | str) -> dict[str, Column]:
    """Hour, day of week (Monday 0), weekend, year and quarter."""
    ts = _c(ts)
    day = F.weekday(ts)
    return {"hour": F.hour(ts), "day_of_week": day, "weekend": day >= 5, "year": F.year(ts), "quarter": F.quarter(ts)}


def log_features(columns: Sequence[str]) -> dict[str, Column]:
    """Natural logarithms of x and of 1 + x: -inf of 0, NaN below, as in NumPy; null of null only."""

    def log(x: Column, f: Column) -> Column:
        return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(f)

    return {k: v for c in columns for k, v in ((f"log_{c}", log(F.col(c), F.log(c))), (f"log1p_{c}", log(F.col(c) + 1, F.log1p(c))))}


def effect_label(r: Column | str) -> Column:
    """Size of a correlation by the usual bands of 0.1, 0.3 and 0.5."""
    a = F.abs(_c(r))
    return F.when(a >= 0.5, "large").when(a >= 0.3, "medium").when(a >= 0.1, "small").otherwise("negligible")


def strength_label(r: Column | str) -> Column:
    """Interpretation of a correlation: Strong above 0.5, Moderate above 0.3, else Weak."""
    a = F.abs(_c(r))
    return F.when(a > 0.5, "Strong").when(a > 0.3, "Moderate").otherwise("Weak")


def significant(p: Column | str, level: float = 0.05) -> Column:
    """Whether a p value is below ``level``; a missing one is not."""
    return F.coalesce(_c(p) < level, F.lit(False))


def drop_incomplete(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows where any (or all) of the columns is null, NaN or infinite."""
    def bad(c):
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    masks = [bad(c) for c in columns]
    gone = masks[0]
    for m in masks[1:]:
        gone = (gone | m) if how == "any" else (gone & m)
    return df.where(~gone)


def with_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def depeg_events(df: DataFrame, price: str = "price", lo: float = 0.95, hi: float = 1.05) -> DataFrame:
    p = F.col(price)
    return df.where((p < lo) | (p > hi)).withColumn("deviation", F.abs(p - 1))


def depeg_scores(df: DataFrame, day: str = "day", price: str = "price") -> DataFrame:
    gap = F.abs(F.col(price) - 1)
    return df.groupBy(day).agg(F.avg(gap).alias("mean_deviation"), F.max(gap).alias("max_deviation"))


def normalize_category(c: Column | str, known: Sequence[str], aliases: dict[str, str] = CATEGORIES) -> Column:
    """Upper-cased category with aliases resolved; UNKNOWN for null, INVALID for what isn't known."""
    up = F.upper(F.trim(_c(c)))
    for a, b in aliases.items():
        up = F.when(up == a, b).otherwise(up)
    return F.when(up.isNull() | (up == ""), "UNKNOWN").when(up.isin(*known), up).otherwise("INVALID")
