"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, stored

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, "mix"


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0))


def rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target and rate (target / size) of each source.

    Sources in code point order, null last, get the weights in turn and share the total size by them. A target stops at
    `limit` times its source's size, and the excess is shared among the others by weight until no target is above: with
    sources in the order of limit * size / weight, a source is at its limit if what those before it leave, shared by
    weight, exceeds it. Works on one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    most = F.col("source_size") * limit
    order = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighted.withColumn("nth", F.row_number().over(order)).withColumn("unit", left / weight_left).withColumn("full", F.col("weight") * F.col("unit") > most)
    shared = shared.withColumn("unit", F.min_by(F.when(~F.col("full"), F.col("unit")), F.when(~F.col("full"), F.col("nth"))).over(everything))
    target = F.when(F.col("full"), most.cast("double")).otherwise(F.least(F.col("weight") * F.col("unit"), most.cast("double")))
    return shared.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def chance(seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and doc_id alone: the same on every run and in any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, text and any other columns but those added) with size, source_size, target and n_copies.

    n_copies is floor(rate), plus one with probability equal to the fraction. A null text has size 0, a null source is a
    source of its own, repeated rows are treated alike, an empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "n_copies").withColumn("size", words())
    side = stored(rates(docs.select("source", "size"), weights, limit), "mix-rates")
    side = checked_broadcast(side.select(F.col("source").alias("_source"), "source_size", "target", "rate"))
    joined = docs.join(side, docs["source"].eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    return joined.withColumn("n_copies", (whole + (chance(seed) < F.col("rate") - whole).cast("long")).cast("long")).drop("rate")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns and the number of the copy from 0."""
    found = copies(docs, **options).where("n_copies > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1))).drop("n_copies", "size", "source_size", "target")
