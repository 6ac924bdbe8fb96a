"""Cases that went wrong once: shared hashes, null ids beside others, repeated rows in one block."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exchange, fingerprints, jaccard, lm, quality

SF = "/root/testdata/sf0.001"


def test_sets_that_share_a_name_stay_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    want = {tuple(r) for r in jaccard.jaccard_components(docs).collect()}
    assert {tuple(r) for r in jaccard.jaccard_components(docs, name_bits=9).collect()} == want
    sh = np.arange(5, dtype=np.uint64)
    first = jaccard.node_of(sh, (frozenset(), 9))
    assert jaccard.node_of(sh, (frozenset([first[0]]), 9))[0] != first[0] < 512


def test_null_id_in_a_run_with_others(spark):
    rows = [(i, f"text number {i} " * 3) for i in range(300)] + [(None, "the one without an id")]
    found = fingerprints.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [rows[-1], *rows[:-1]]
    want = {}
    for (i, own), (_, then) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(own) // 2
        want[i] = hashlib.sha256((own[: len(own) - half] + then[:half]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in found} == want


def test_rejected_row_with_the_hash_of_a_kept_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good", "en"), (2, "bad", "en"), (None, "good too", "en")], "doc_id long, text string, lang string")
    row = F.xxhash64("doc_id", "text")
    verdicts = docs.select(row.alias("_row"), "doc_id", (F.col("text") != "bad").alias("kept"))
    verdicts = verdicts.unionAll(docs.where("doc_id = 2").select(row, F.lit(77).cast("long"), F.lit(True)))  # another row with its hash, kept
    monkeypatch.setattr(quality, "classify", lambda *a, **k: verdicts)
    assert {r.text for r in quality.keep_quality(docs, docs).collect()} == {"good", "good too"}


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeated") / "documents.parquet")
    spark.createDataFrame([(7, "the same row of the same text", "en")] * 3000 + [(i, f"other text {i}", "de") for i in range(50)], "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_copies_of_one_row_are_dealt_to_blocks(spark, repeated):
    blocks = repeated.where("doc_id = 7 AND lang = 'en'").groupBy(F.pmod(F.xxhash64("doc_id", "text", exchange.own_place(repeated)), F.lit(24)).alias("b")).count()
    assert blocks.count() == 24 and blocks.agg(F.max("count")).first()[0] < 250
    inline = spark.createDataFrame(repeated.collect(), repeated.schema)
    assert "row_index" not in str(exchange.own_place(inline))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(lm.score_texts(repeated)) == key(lm.score_texts(inline))
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    rounded = lambda df: key(df.select("doc_id", "kept", F.round("perplexity", 3)))
    assert rounded(quality.classify(repeated, labels)) == rounded(quality.classify(inline, labels))
