import pytest
from pyspark.sql import functions as F

from tidemill.functions import expressions as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "visible", "masked"), [("4111111111111111", 4, "************1111"), ("123", 4, "***"), ("1234", 4, "****"), ("12345", 0, "*****"), ("12345", -2, "*****"), ("123456", None, "**3456"), (None, 4, None)])
def test_mask_pan(spark, value, visible, masked):
    assert one(spark, X.mask_pan(F.lit(value).cast("string"), visible)) == masked


def test_haversine(spark):
    assert 9100 < one(spark, X.haversine_km(F.lit(33.4484), F.lit(-112.074), F.lit(47.3769), F.lit(8.5417))) < 9400
    assert one(spark, X.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None


def test_weighted_avg(spark):
    df = spark.createDataFrame([(10, 1), (20, 3), (99, 0), (None, 5), (7, None)], "v int, w int")
    assert df.agg(X.weighted_avg(F.col("v"), F.col("w"))).first()[0] == 17.5
    assert df.where("w = 0").agg(X.weighted_avg(F.col("v"), F.col("w"))).first()[0] is None


def test_money(spark):
    assert str(one(spark, X.money(F.expr("1.005") + F.expr("2.1")))) == "3.11"
    assert str(one(spark, X.money(F.lit(None).cast("decimal(4,2)")))) == "0.00"


def test_murmur2_vectors_and_spread():
    assert X.murmur2(b"21") & 0xFFFFFFFF == -973932308 & 0xFFFFFFFF
    assert X.murmur2(b"foobar") == -790332482 & 0xFFFFFFFF
    assert X.murmur2(b"abc") == 479470107
    counts = [0] * 12
    for i in range(400):
        counts[X.partition_for(f"acct-{i:05d}", 12)] += 1
    assert min(counts) > 400 / 24 and max(counts) < 400 / 6


def test_sql_functions(spark):
    X.register(spark)
    assert spark.sql("SELECT mask_pan('4111111111111111'), mask_pan('12345', 2)").first()[:2] == ("************1111", "***45")
