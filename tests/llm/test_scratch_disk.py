"""What steps leave on disk: no shuffle files once their table is written, and few rows in the shuffle of a selective join."""

import time

from pyspark.sql import functions as F
from tidemill.llm import common


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {x for x in names if x.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(common.FILE_CLEANUP, None)
    numbers = spark.range(20_000, numPartitions=4)
    held = common.stored(numbers.repartition(3, F.xxhash64("id")).join(numbers.groupBy(F.col("id") % 5000).count().hint("merge"), F.col("id") == F.col("(id % 5000)")), "held")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert held.count() == 5000
    assert spark.conf.get(common.FILE_CLEANUP, None) == was


def test_a_sieve_keeps_every_match_and_few_other_rows(spark):
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("core"))
    keys = common.stored(rows.where("id % 100 = 7 OR core & 63 = 63 AND id < 2000").select("core"), "keys")
    kept = common.sifted(rows, keys, "core")
    assert kept.columns == rows.columns
    assert kept.join(keys, "core", "left_semi").count() == keys.count() > 1000
    assert kept.count() < 25_000
    assert kept.count() == kept.select("id").distinct().count()
    nothing = common.stored(keys.limit(0), "nothing")
    assert common.sifted(rows, nothing, "core").count() == 0


def test_a_full_sieve_still_keeps_every_match(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_WORDS", 4)
    rows = spark.range(5000).select(F.xxhash64("id").alias("core"))
    keys = common.stored(rows.limit(3000), "keys")
    assert common.sifted(rows, keys, "core").join(keys, "core", "left_semi").count() == 3000
