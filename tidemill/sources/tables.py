"""The payments domain over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(table(spark, sf_dir, "events"))


def transactions_of(events: DataFrame) -> DataFrame:
    """Events, a table's or a stream's, as transactions; times as TIMESTAMP, which watermarks need."""
    return events.select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), (F.col("event_id") % 60).alias("merchant_id"), F.col("value").cast("decimal(12,2)").alias("amount"),
        F.col("event_type").alias("channel"), (F.col("event_id") % 12).cast("int").alias("shard_id"), F.col("ts").cast("timestamp").alias("event_time"), F.get_json_object("props", "$.k").alias("k"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their region; filters on keys reach the scans."""
    at = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return at.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("account_id"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("risk_band"))


def account_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as versions of their user: band and since."""
    return transactions(spark, sf_dir).where("channel = 'signup'").select("account_id", F.concat(F.lit("B"), F.col("txn_id") % 5).alias("band"), F.col("event_time").alias("since"), F.col("txn_id").alias("version_id"))


def generated(spark: SparkSession, rows: int, seed: int = 7, accounts: int = 400, merchants: int = 60, rate: float = 40.0) -> DataFrame:
    """Deterministic transactions: a seeded hash of the row's number gives each field, 3 % come one to three minutes late."""
    draw = lambda what: (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(1_000_000)) / 1_000_000)
    channel, when = draw("channel"), F.lit(1767261600.0) + F.col("id") / rate
    late = F.when(draw("late") < 0.03, 60 + 120 * draw("delay")).otherwise(4 * draw("delay"))
    return spark.range(rows).select(
        F.concat(F.lit("txn-"), F.lpad("id", 8, "0")).alias("txn_id"), F.format_string("acct-%05d", F.floor(draw("account") * accounts)).alias("account_id"), F.format_string("mch-%04d", F.floor(draw("merchant") * merchants)).alias("merchant_id"),
        F.round(F.exp(1 + 5 * draw("amount")), 2).cast("decimal(12,2)").alias("amount"), F.when(draw("fx") < 0.8, "USD").otherwise(F.element_at(F.array(*map(F.lit, ("EUR", "GBP", "JPY", "CAD", "MXN"))), (1 + F.floor(draw("currency") * 5)).cast("int"))).alias("currency"),
        F.when(channel < 0.55, "CARD_PRESENT").when(channel < 0.85, "CARD_NOT_PRESENT").when(channel < 0.93, "ATM").when(channel < 0.98, "WIRE").otherwise("ACH").alias("channel"), F.timestamp_micros(((when - late) * 1_000_000).cast("long")).alias("event_time"),
    )
