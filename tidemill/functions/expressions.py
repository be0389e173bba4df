"""Scalar and aggregate functions as column expressions, so that they stay in generated code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
EARTH_KM = 6371.0088


def money(x: Column, precision: int = 14) -> Column:
    """Two decimals, half up; null counts as zero."""
    return F.coalesce(x, F.lit(0)).cast(f"decimal({precision},2)")


def money_max(x: Column, precision: int = 14) -> Column:
    """Largest amount, zero at least."""
    return F.greatest(money(F.max(x), precision), F.lit(0).cast(f"decimal({precision},2)"))


def amount_band(x: Column) -> Column:
    return F.when(x < 25, "MICRO").when(x < 250, "SMALL").when(x < 2500, "MEDIUM").otherwise("LARGE")


def mask_pan(value: Column, visible: Column | int | None = 4) -> Column:
    """Stars but for the last `visible` characters (null: 4, below 0: none); a value no longer than that is all stars."""
    keep = F.greatest(F.coalesce(visible if isinstance(visible, Column) else F.lit(visible).cast("int"), F.lit(4)), F.lit(0))
    n = F.length(value)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.substring(value, n - keep + 1, keep)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any part is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


# Weight of each channel in the risk score.
CHANNEL_RISK = {"CARD_NOT_PRESENT": 0.35, "WIRE": 0.25, "ATM": 0.15}
OTHER_RISK = 0.05


def risk_score(channel: Column, amount: Column, trust: Column, weights: dict[str, float] = CHANNEL_RISK) -> Column:
    """min(1, half of the missing trust + channel weight + amount weight), to three decimals."""
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[channel], F.lit(OTHER_RISK))
    score = (1 - F.coalesce(trust, F.lit(0.0))) * 0.5 + weight + F.least(F.lit(0.3), amount.cast("double") / 10000)
    return F.floor(F.least(F.lit(1.0), score) * 1000 + 0.5) / 1000


def weighted_avg(value: Column, weight: Column) -> Column:
    """Sum of value x weight over the sum of weights, over rows where both are given and the weight isn't zero."""
    used = value.isNotNull() & weight.isNotNull() & (weight != 0)
    total = F.sum(F.when(used, weight))
    return F.when(total != 0, F.sum(F.when(used, value * weight)) / total)


def explode_tags(tags: Column, outer: bool = False) -> Column:
    """One row per entry of a map; without `outer`, rows with a null or empty map go."""
    return (F.explode_outer if outer else F.explode)(tags)


def murmur2(data: bytes) -> int:
    """MurmurHash2, 32 bits, with the seed that message brokers' default partitioner has."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for (k,) in np.frombuffer(data[:whole], dtype="<u4").reshape(-1, 1).tolist():
        k = k * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    if rest := data[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def partition_for(key: str, partitions: int) -> int:
    return (murmur2(key.encode()) & 0x7FFFFFFF) % partitions


def shard_of(key: Column, partitions: int) -> Column:
    """The partition that a keyed producer sends a key to (null: null), in Arrow batches; each distinct key is hashed once."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        known = {k: partition_for(k, partitions) for k in keys.dropna().unique()}
        return keys.map(known).astype("Int32")

    return shard(key)


def register(spark: SparkSession) -> None:
    """The functions under their SQL names, for scripts."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_pan(v STRING, k INT DEFAULT 4) RETURNS STRING RETURN CASE WHEN length(v) <= greatest(coalesce(k, 4), 0) THEN repeat('*', length(v)) ELSE concat(repeat('*', length(v) - greatest(coalesce(k, 4), 0)), right(v, greatest(coalesce(k, 4), 0))) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN 2 * {EARTH_KM} * atan2(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)), sqrt(1 - (pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))")
