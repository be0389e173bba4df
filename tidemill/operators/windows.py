"""Event-time windows as relations: each adds a `window` struct to group by, in batch and in streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumble(df: DataFrame, time: str, width: str) -> DataFrame:
    return df.withColumn("window", F.window(time, width))


def hop(df: DataFrame, time: str, width: str, slide: str) -> DataFrame:
    return df.withColumn("window", F.window(time, width, slide))


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per key and session; events exactly one gap apart are in one session."""
    return df.groupBy(*keys, F.session_window(time, gap).alias("window")).agg(*aggregates)


def cumulate(df: DataFrame, time: str, step_seconds: int, most_seconds: int) -> DataFrame:
    """Windows that share a start and grow by steps: each row falls in all that end after it."""
    start = F.floor(F.col(time).cast("double") / most_seconds) * most_seconds
    nth = F.floor((F.col(time).cast("double") - start) / step_seconds).cast("int")
    ends = F.sequence(nth + 1, F.lit(most_seconds // step_seconds))
    at = df.withColumn("_start", start.cast("long")).withColumn("_n", F.explode(ends))
    window = F.struct(F.timestamp_seconds("_start").alias("start"), F.timestamp_seconds(F.col("_start") + F.col("_n") * step_seconds).alias("end"))
    return at.withColumn("window", window).drop("_start", "_n")


def bounds(df: DataFrame) -> DataFrame:
    """window as window_start and window_end."""
    return df.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered as rnk; the optimizer limits each task's groups before the shuffle."""
    return df.withColumn("rnk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rnk") <= n)


def top_n_streaming(df: DataFrame, window: str, value: str, key: str, n: int) -> DataFrame:
    """The same for a stream of window results, where OVER isn't allowed: a second aggregate of bounded lists."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col(value), F.col(key))), asc=False), 1, n)
    return df.groupBy(window).agg(best.alias("best")).select(window, F.posexplode("best").alias("pos", "x")).select(window, (F.col("pos") + 1).cast("long").alias("rnk"), "x.*")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def max_before(df: DataFrame, key: str, order: str, value: str, out: str, rows: int = 1_000_000) -> DataFrame:
    """Adds `out`: the largest `value` of the key's rows before this one by `order`, a whole number; null for the first.

    A key's rows are dealt by ranges of `rows` of that number, so no task holds a hot key whole: one maximum a range is
    carried forward, and the rows of a range go on from it."""
    nth = F.floor(F.col(order) / rows)
    ends = df.groupBy(key, nth.alias("_part")).agg(F.max(value).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(F.col(key).alias("_of"), F.col("_part").alias("_at"), F.max("_end").over(earlier).alias("_head"))
    within = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_part", nth).withColumn("_own", F.max(value).over(within))
    found = own.join(heads, F.col(key).eqNullSafe(F.col("_of")) & F.col("_part").eqNullSafe(F.col("_at")), "left")
    return found.withColumn(out, F.greatest("_own", "_head")).drop("_part", "_own", "_of", "_at", "_head")
