"""Tables of intermediate results."""

import os
import time

from pyspark.sql import functions as F

from tidemark import scratch


def test_shuffle_files_go_with_the_write(spark):
    def held():
        base = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return sum(f.endswith((".data", ".index")) for d in base for _, _, files in os.walk(d) for f in files)

    def shuffled():
        return spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    before, setting = held(), spark.conf.get(scratch.CLEANUP, None)
    table = scratch.materialize(shuffled())
    for _ in range(100):  # executors are told, not awaited
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert table.count() == 5000
    assert spark.conf.get(scratch.CLEANUP, None) == setting


def test_setting_is_restored_after_a_failure(spark):
    setting = spark.conf.get(scratch.CLEANUP, None)
    try:
        with scratch.shuffle_files_removed(spark):
            assert spark.conf.get(scratch.CLEANUP) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(scratch.CLEANUP, None) == setting
