"""URL filters: prefix rules, and exact domain lists in a Bloom filter cascade.

The cascade knows the complete universe of keys it will be asked about: every host of the corpus and its parent
domains. Level 0 encodes the listed keys; the unlisted keys that it lets through are encoded in level 1, the listed
keys that level 1 lets through in level 2, and so on until none is left. The first level that rejects a key decides,
so membership is exact, in a few bits for each listed key, and pages are judged without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Domains of the query's list.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Rules are a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    found = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.length(host) > 0, found).otherwise(F.array().cast("array<string>"))


def _h1(key: Column) -> Column:
    return F.xxhash64(key)


def _h2(key: Column) -> Column:
    return F.xxhash64(F.lit(1), key)  # another seed: keys that share the first hash don't share this one


def _places(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """k bit positions for each key, other ones on each level."""
    with np.errstate(over="ignore"):
        mixed = h1 + np.uint64(level + 1) * (h2 | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        steps = np.arange(k, dtype=np.uint64)[:, None] * (h2 ^ (mixed << np.uint64(1)) | np.uint64(1))
        return (mixed + steps) % np.uint64(bits)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, filter) of each level for keys given by two 64-bit hashes."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        rate = min(0.5, len(inside) / max(len(outside), 1) * math.sqrt(0.5)) if not levels else 0.5
        k = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(inside) * k / math.log(2)))
        field = np.zeros(bits, dtype=bool)
        field[_places(h1[inside], h2[inside], len(levels), k, bits)] = True
        passed = outside[field[_places(h1[outside], h2[outside], len(levels), k, bits)].all(axis=0)] if len(outside) else outside
        levels.append((bits, k, np.packbits(field).tobytes()))
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key share both hashes")
        inside, outside = passed, inside
    return levels


def probe(levels: Sequence[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    found, open_ = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
    for level, (bits, k, field) in enumerate(levels):
        passed = field[_places(h1[open_], h2[open_], level, k, bits)].all(axis=0)
        found[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
        if not len(open_):
            return found
    found[open_] = len(levels) % 2 == 1
    return found


class Cascade:
    """A cascade over a key universe, in shards by hash, each built by one task from a bounded number of keys.

    ``universe`` and ``listed`` have a column key; nulls and repeats don't matter. Listed keys outside the universe are
    part of it. The shards are kept as a table in the shared folder.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, keys_per_shard: int = 100_000, broadcast_mb: int = 64):
        both = universe.select("key", F.lit(0).alias("in")).unionByName(listed.select("key", F.lit(1).alias("in")))
        keys = materialize(both.where("key is not null").groupBy("key").agg(F.max("in").alias("in")).select(
            _h1(F.col("key")).alias("h1"), _h2(F.col("key")).alias("h2"), F.col("in")), "keys")
        self.broadcast_bytes, self.shards = broadcast_mb << 20, max(1, math.ceil(keys.count() / keys_per_shard))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h1", "h2"])
            levels = build_levels(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf["in"].to_numpy() == 1)
            rows = [(pdf.shard.iloc[0], i, *level) for i, level in enumerate(levels)]
            return pd.DataFrame(rows, columns=["shard", "level", "bits", "hashes", "filter"])

        self.levels = materialize(
            keys.withColumn("shard", self.shard_of(F.col("h1"))).groupBy("shard")
            .applyInPandas(build, "shard long, level int, bits long, hashes int, filter binary"),
            "cascade",
        )

    def shard_of(self, h1: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h1, 7), F.lit(self.shards))

    def _groups(self) -> list[list[int]]:
        """Shards put together so that the filters of a group stay within the broadcast bound."""
        groups, left = [], 0
        for row in sorted(self.levels.groupBy("shard").agg(F.sum(F.length("filter")).alias("n")).collect()):
            if not groups or row["n"] > left:
                groups.append([])
                left = self.broadcast_bytes
            groups[-1].append(row["shard"])
            left -= row["n"]
        return groups

    def mark(self, df: DataFrame, keys: Column, name: str) -> DataFrame:
        """Add array<boolean> ``name``: for each of the row's ``keys`` (array<string>), whether it is listed.

        Filters are broadcast one bounded group of shards at a time; a list beyond the bound takes several passes over
        the rows, which are written between them.
        """
        df = df.withColumn("_h", F.transform(keys, lambda k: F.struct(_h1(k).alias("h1"), _h2(k).alias("h2"))))
        df = df.withColumn(name, F.transform("_h", lambda h: F.lit(False)))
        for turn, group in enumerate(self._groups()):
            if turn:
                df = materialize(df, "marked")
            rows = self.levels.where(F.col("shard").isin(group)).orderBy("shard", "level").collect()
            shards: dict[int, list] = {}
            for r in rows:
                shards.setdefault(r["shard"], []).append((r["bits"], r["hashes"], bytes(r["filter"])))
            sent, n_shards = df.sparkSession.sparkContext.broadcast(shards), self.shards

            @F.pandas_udf("array<boolean>")
            def in_group(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                levels = {s: [(b, k, np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)) for b, k, f in x] for s, x in sent.value.items()}
                for h1s, h2s in parts:
                    sizes = h1s.map(len).to_numpy()
                    flat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
                    h1, h2 = flat(h1s), flat(h2s)
                    shard, found = ((h1 >> np.uint64(7)) % np.uint64(n_shards)).astype(np.int64), np.zeros(len(h1), dtype=bool)
                    for s, x in levels.items():
                        at = np.flatnonzero(shard == s)
                        found[at] = probe(x, h1[at], h2[at])
                    yield pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

            hit = in_group(F.transform("_h", lambda h: h["h1"]), F.transform("_h", lambda h: h["h2"]))
            df = df.withColumn(name, F.zip_with(name, hit, lambda a, b: a | b))
        return df.drop("_h")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every url: ``id_col``, host, path, rule, listed_domain, verdict.

    The longest fitting rule decides; without one, a url whose host or any parent domain is in ``listed`` (column key)
    is blocked and others are allowed. A null url, or one without ``://``, has an empty host and path, fits no rule and
    is allowed. Repeated rows are judged each for itself; with an empty list only the rules block.
    """
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = urls.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key"))
    marked = Cascade(universe, listed).mark(urls.withColumn("_domains", domains_of(F.col("host"))), F.col("_domains"), "_listed")
    domain = F.get(F.filter(F.zip_with("_domains", "_listed", lambda d, x: F.when(x, d)), lambda d: d.isNotNull()), F.lit(0))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed_domain").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return marked.withColumn("listed_domain", domain).select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), "listed_domain", F.coalesce(verdict, method).alias("verdict")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED], "key string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, listed)


OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), list AS (SELECT unnest([{", ".join(f"'{d}'" for d in LISTED)}]) AS domain
), hit AS (
  SELECT host, arg_max(domain, length(domain)) AS listed_domain
  FROM (SELECT DISTINCT host FROM parts) JOIN list ON host = domain OR ends_with(host, '.' || domain) GROUP BY host
), ruled AS (
  SELECT page_id, parts.host, path, listed_domain,
         CASE WHEN (parts.host = 'example.net' OR ends_with(parts.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (parts.host = 'example.com' OR ends_with(parts.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (parts.host = 'org' OR ends_with(parts.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (parts.host = 'net' OR ends_with(parts.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts LEFT JOIN hit ON parts.host = hit.host
)
SELECT page_id, host, path, rule, listed_domain,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
            WHEN listed_domain IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
