"""Queries about jobs as a whole: calls outside, selected parts, plans, catalogs and what a job observes of itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.enrichment import asynchronously
from tidemill.plans import registry
from tidemill.plans.registry import TOTAL, dbl, query
from tidemill.plans.script import Script
from tidemill.sources import sinks
from tidemill.sources.tables import transactions, transactions_of
from tidemill.streaming.runs import file_stream, run_all

SCORE = "CASE WHEN txn_id % 97 = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, CAST(amount AS DOUBLE) / 512 + 0.125::DOUBLE) END"


def _score(row: dict) -> float:
    """Stands for a service that can't answer for some."""
    if row["txn_id"] % 97 == 0:
        raise ConnectionError("no answer")
    return min(1.0, row["amount"] / 512 + 0.125)


@query(f"SELECT txn_id, {SCORE} AS risk FROM txn")
def async_order(spark, d):
    """A stream's rows scored by calls that overlap, in no order within a batch; 0.5 where a call fails."""
    t = transactions_of(file_stream(spark, f"{d}/events.parquet")).select("txn_id", dbl(F.col("amount")).alias("amount"))
    return run_all(asynchronously(t, _score, "risk", "double", 0.5), "scored").select("txn_id", "risk")


#: Parts of a job that can be run by name.
LABS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"tumbling": registry.win_tumble_ds, "sliding": registry.win_hop, "session": registry.win_session, "late": registry.late_side_output, "travel": registry.mr_impossible_travel}


def labs(names: str | Iterable[str]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The parts named, as in 'tumbling,late'; 'all' or nothing: all. A name that isn't known is an error."""
    chosen = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]
    if unknown := sorted(set(chosen) - {*LABS, "all"}):
        raise ValueError(f"unknown: {', '.join(unknown)}; there are {', '.join(LABS)}")
    return {n: f for n, f in LABS.items() if not chosen or "all" in chosen or n in chosen}


@query(f"SELECT 'late' AS lab, count(*) AS n FROM ({registry.LATE}) UNION ALL SELECT 'tumbling', count(*) FROM ({registry.TUMBLE})")
def job_selectable_labs(spark, d):
    """The rows that each chosen part yields."""
    made = [f(spark, d).agg(F.lit(n).alias("lab"), F.count("*").alias("n")) for n, f in labs("tumbling, late").items()]
    return reduce(DataFrame.unionByName, made)


@query("SELECT 2 AS aggregates, 1 AS shuffles, TRUE AS reads_two_columns")
def explain(spark, d):
    """The plan of an aggregate: a partial and a final step about one shuffle, over a scan of its columns only."""
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events_in")
    plan = Script(spark).explain("SELECT event_type, SUM(value) AS total FROM events_in GROUP BY event_type")
    return spark.createDataFrame([(plan.count("HashAggregate("), plan.count("Exchange hashpartitioning"), "ReadSchema: struct<event_type:string,value:double>" in plan)], "aggregates int, shuffles int, reads_two_columns boolean")


@query(f"SELECT account_id, {TOTAL} AS total_usd, count(*) AS n FROM (SELECT * FROM txn) GROUP BY account_id")
def agg_two_phase(spark, d):
    """Totals by hand in two steps: a hot account's rows are summed under 16 salts before they meet."""
    salted = transactions(spark, d).withColumn("salt", F.pmod(F.xxhash64("txn_id"), F.lit(16))).groupBy("account_id", "salt").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    return salted.groupBy("account_id").agg(registry.total().alias("total_usd"), F.sum("n").alias("n"))


@query("SELECT count(*) AS rows_seen, CAST(count(DISTINCT shard_id) AS INTEGER) AS shards FROM txn")
def map_shard_observer(spark, d):
    """What an observer on the way saw of a run: its rows, and which of the twelve shards."""
    seen = Observation()
    watched = transactions(spark, d).observe(seen, F.count("*").alias("rows"), F.collect_set("shard_id").alias("shards"))
    sinks.append(sinks.shared_folder(spark, "observed"))(watched, 0)
    return spark.createDataFrame([(seen.get["rows"], len(seen.get["shards"]))], "rows_seen long, shards int")


@query("SELECT 'an append-only sink can''t take a changelog; aggregate per window or use an upsert sink' AS error")
def changelog_append_check(spark, d):
    """A script whose changelog goes into a sink without a key is refused."""
    registry.to_changelog(spark, d).withColumnRenamed("op", "_op").createOrReplaceTempView("changes_in")
    sink = f"CREATE TABLE changes_out (account_id BIGINT, n BIGINT) WITH ('connector' = 'filesystem', 'path' = '{sinks.shared_folder(spark, 'refused')}', 'mode' = 'sink');"
    try:
        Script(spark).run(sink + "INSERT INTO changes_out SELECT account_id, n, _op FROM changes_in")
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")
    raise AssertionError("the changelog was taken")


@query("SELECT channel, count(*) AS n FROM txn GROUP BY channel")
def catalog_ddl(spark, d):
    """A database made by a script, a table in it, and the table read under its full name."""
    place = sinks.shared_folder(spark, "lake")
    database = f"lake_{place.rsplit('-', 1)[1]}"
    transactions(spark, d).createOrReplaceTempView("catalog_in")
    Script(spark).one(f"CREATE DATABASE IF NOT EXISTS {database} WITH ('location' = '{place}')")
    spark.sql(f"CREATE TABLE {database}.channels USING parquet AS SELECT channel, COUNT(*) AS n FROM catalog_in GROUP BY channel")
    return spark.table(f"{database}.channels")
