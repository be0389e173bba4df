"""Joins in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes up to which a dimension is broadcast; its size comes from the optimizer's statistics.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Hints a broadcast only if the plan's size estimate allows it; otherwise the join shuffles."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def asof_left(facts: DataFrame, versions: DataFrame, key: str, time: str, since: str, take: list[str], slice_seconds: int | None = None) -> DataFrame:
    """Each fact with the newest version of its key that is not later than the fact, or nulls.

    Facts and versions are laid in one order per key (a version before a fact of the same time) and the last version is
    carried forward: one shuffle and one sort, no join of all pairs. A version of null `take` values is a deletion's
    record and hides older ones. Facts without key or time get nulls and are not shuffled.

    With `slice_seconds` a key's rows are dealt by slices of time as well, so that no task holds a hot key whole: the
    last version before each slice that has facts goes ahead of it, found from one row per key and slice.
    """
    version = F.struct(F.col(since).alias(since), *[F.col(c) for c in take])
    given = F.col(key).isNotNull() & F.col(time).isNotNull()
    known = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_key"), F.col(since).alias("_at"), version.alias("_version"))
    shape = known.schema["_version"].dataType
    wanted = facts.where(given).select(F.struct(*facts.columns).alias("_fact"), F.col(key).alias("_key"), F.col(time).alias("_at"))
    rows = wanted.withColumns({"_version": F.lit(None).cast(shape), "_side": F.lit(1)})
    sides = known.select(F.lit(None).cast(rows.schema["_fact"].dataType).alias("_fact"), "*", F.lit(0).alias("_side"))
    parts = ["_key"]
    if slice_seconds:
        parts.append("_slice")
        nth = F.floor(F.col("_at").cast("double") / slice_seconds)
        rows, sides = rows.withColumn("_slice", nth), sides.withColumn("_slice", nth)
        ends = known.groupBy("_key", nth.alias("_slice")).agg(F.max_by("_version", "_at").alias("_version"))
        asked = wanted.select("_key", nth.alias("_slice")).distinct()
        before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        heads = ends.unionByName(asked, allowMissingColumns=True).groupBy("_key", "_slice").agg(F.first("_version", ignorenulls=True).alias("_version"))
        heads = heads.withColumn("_version", F.last("_version", ignorenulls=True).over(before)).where("_version IS NOT NULL")
        sides = sides.unionByName(heads.select(F.lit(None).cast(rows.schema["_fact"].dataType).alias("_fact"), "_key", F.col(f"_version.{since}").alias("_at"), "_version", F.lit(0).alias("_side"), "_slice"))
    order = Window.partitionBy(*parts).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(sides).withColumn("_found", F.last("_version", ignorenulls=True).over(order)).where("_side = 1").select("_fact", "_found")
    rest = facts.where(~given).select(F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(shape).alias("_found"))
    return found.unionByName(rest).select("_fact.*", F.col(f"_found.{since}").alias("version_time"), *[F.col(f"_found.{c}").alias(c) for c in take])


def compacted(versions: DataFrame, key: str, since: str, horizon: Column) -> DataFrame:
    """Versions that a fact at `horizon` or later may still ask for: each key's newest one up to it, and all later."""
    old = F.col(since) <= horizon
    newest = Window.partitionBy(key, old).orderBy(F.desc(since))
    return versions.withColumn("_n", F.rank().over(newest)).where(~old | (F.col("_n") == 1)).drop("_n")


def interval(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, low: str, high: str) -> DataFrame:
    """Inner join on key with right_time in [left_time + low, left_time + high]. On streams with watermarks the bounds
    let both sides' state go. right's key column is named key as well and is dropped."""
    other = right.withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(right_time) >= F.col(left_time) + F.expr(f"INTERVAL {low}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {high}"))
    return left.join(other, near).drop("_key")


def lookup(facts: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Left join with a table's current rows."""
    return facts.join(small(current), key, "left")


def enrich(facts: DataFrame, dimension: DataFrame, key: str, take: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every fact with the dimension's columns (nulls where it has none), and dead letters for those without."""
    marked = dimension.select(key, *take, F.lit(True).alias("_known"))
    joined = facts.join(small(marked), key, "left")
    dead = joined.where("_known IS NULL").select(F.col(key).cast("string").alias("record_key"), F.lit("UNKNOWN_MERCHANT").alias("reason"), F.lit("MerchantEnrichment").alias("stage"))
    return joined.drop("_known"), dead


def latest_version(versions: DataFrame, key: str, since: str, *ties: str) -> DataFrame:
    """The newest version of each key, by map-side maxima."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(since, *ties)).alias("_v")).select(key, "_v.*")


def versioned(facts: DataFrame, versions: DataFrame, key: str, since: str, take: list[str], unknown: Column) -> DataFrame:
    """Facts with the newest version's columns, `unknown` where a key has none."""
    found = facts.join(latest_version(versions.select(key, since, *take), key, since, *take).drop(since), key, "left")
    return found.select(*facts.columns, *[F.coalesce(c, unknown).alias(c) for c in take])


def window_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two window aggregates on their keys and window."""
    return left.join(right, [*keys, "window"], "left")
