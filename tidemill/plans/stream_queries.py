"""Queries that run as Structured Streaming over the events until these are used up, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import windows as W
from tidemill.plans.registry import BUCKET, INTERVAL, TOTAL, VELOCITY, dbl, query, total, us
from tidemill.sources.tables import account_versions, table, transactions, transactions_of
from tidemill.streaming.runs import NEVER_IDLE, file_stream, newest, replay, run_all
from tidemill.streaming.state import AsOf, Changelog, FirstSeen, LateWindows, VelocityAlerts, stateful


def _stream(spark, d) -> DataFrame:
    """Transactions with a watermark five seconds behind the newest."""
    return transactions_of(file_stream(spark, f"{d}/events.parquet")).withWatermark("event_time", "5 seconds")


CLOSED_BEHIND = f"SELECT channel, epoch_us(w) AS window_start, count(*) AS txn_count, {TOTAL} AS total_usd FROM (SELECT *, {BUCKET.format('1 day')} AS w FROM txn) WHERE w + INTERVAL '1 day' <= (SELECT max(event_time) FROM txn) - INTERVAL '{{}} seconds' GROUP BY channel, w"
CLOSED = CLOSED_BEHIND.format(5)


@query(CLOSED, name="wm_bounded")
@query(CLOSED)
def win_append_only(spark, d):
    """Only windows that the watermark has closed come out, once each."""
    made = W.tumble(_stream(spark, d), "event_time", "1 day").groupBy("channel", "window").agg(F.count("*").alias("txn_count"), total().alias("total_usd"))
    return run_all(W.bounds(made).select("channel", us("window_start").alias("window_start"), "txn_count", "total_usd"), "closed").drop("batch")


@query(f"SELECT account_id, count(*) AS txn_count, {TOTAL} AS total_usd FROM txn GROUP BY account_id")
def agg_minibatch(spark, d):
    """Running totals, updated a batch at a time; the last update of each account."""
    made = transactions_of(file_stream(spark, f"{d}/events.parquet", 1)).groupBy("account_id").agg(F.count("*").alias("txn_count"), total().alias("total_usd"))
    return newest(run_all(made, "running", "update"), ["account_id"])


@query("SELECT txn_id, channel FROM txn WHERE channel IN ('error', 'view')")
def union_stream(spark, d):
    t = _stream(spark, d).select("txn_id", "channel")
    return run_all(t.where("channel = 'error'").unionByName(t.where("channel = 'view'")), "union").drop("batch")


@query("SELECT txn_id, s_name AS name FROM txn LEFT JOIN supplier ON merchant_id = s_suppkey")
def wm_none(spark, d):
    """A static side never holds back the stream's time."""
    side = table(spark, d, "supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"))
    return run_all(_stream(spark, d).join(side, "merchant_id", "left").select("txn_id", "name"), "static").drop("batch")


@query("SELECT t.txn_id, a.txn_id AS auth_id FROM (SELECT * FROM txn WHERE channel = 'purchase') t JOIN (SELECT * FROM txn WHERE channel = 'view') a ON t.account_id = a.account_id AND a.event_time BETWEEN t.event_time - INTERVAL '2' HOUR AND t.event_time + INTERVAL '45' HOUR")
def stream_interval_join(spark, d):
    """Both sides' state goes once the watermarks have left the interval behind."""
    from tidemill.operators import joins as J

    t = _stream(spark, d)
    auths = t.where("channel = 'view'").select("account_id", F.col("txn_id").alias("auth_id"), F.col("event_time").alias("auth_time"))
    return run_all(J.interval(t.where("channel = 'purchase'").select("txn_id", "account_id", "event_time"), auths, "account_id", "event_time", "auth_time", "-2 HOUR", "45 HOUR").select("txn_id", "auth_id"), "interval").drop("batch")


@query("SELECT CAST(account_id AS VARCHAR) AS key, min(txn_id) AS id FROM txn GROUP BY account_id", name="state_sql_ttl")
@query("SELECT CAST(account_id AS VARCHAR) AS key, min(txn_id) AS id FROM txn GROUP BY account_id")
def state_ttl(spark, d):
    """First row of each account, whose state expires after an hour."""
    rows = transactions_of(file_stream(spark, f"{d}/events.parquet")).select(F.col("account_id").cast("string").alias("key"), F.col("txn_id").alias("id"))
    return run_all(stateful(rows, "key", FirstSeen(), "ProcessingTime"), "first", one_batch=True).drop("batch")


REFIRE = """SELECT shard_id, epoch_us(w) AS window_start, kind, n, CAST(CAST(total AS DECIMAL(14,2)) AS DOUBLE) AS total FROM (
  WITH moved AS (SELECT txn_id, shard_id, amount, CASE WHEN txn_id % 10 = 0 THEN event_time - INTERVAL '2 days' ELSE event_time END AS tm FROM txn),
  seen AS (SELECT *, time_bucket(INTERVAL '1 day', tm, TIMESTAMP '1970-01-01') AS w, max(tm) OVER (PARTITION BY shard_id ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '5 seconds' AS mark FROM moved),
  kept AS (SELECT *, coalesce(w + INTERVAL '1 day' <= mark, FALSE) AS behind FROM seen WHERE mark IS NULL OR w + INTERVAL '6 days' > mark),
  run AS (SELECT *, count(*) OVER o AS n, sum(amount) OVER o AS total FROM kept WINDOW o AS (PARTITION BY shard_id, w ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT shard_id, w, 'FIRST' AS kind, max(n) AS n, arg_max(total, n) AS total FROM run WHERE NOT behind GROUP BY shard_id, w
  UNION ALL SELECT shard_id, w, 'AGAIN', n, total FROM run WHERE behind)"""


@query(REFIRE)
def late_allowed(spark, d):
    """A window's result at its end, and a corrected one for each row up to five days late (batch form of LateWindows)."""
    from pyspark.sql.window import Window

    from tidemill.sources.tables import transactions

    shifted = F.when(F.col("txn_id") % 10 == 0, F.col("event_time") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("event_time"))
    t = W.max_before(transactions(spark, d).select("txn_id", "shard_id", "amount", shifted.alias("at")), "shard_id", "txn_id", "at", "seen")
    t = t.withColumn("mark", F.col("seen") - F.expr("INTERVAL 5 SECONDS")).withColumn("window", F.window("at", "1 day"))
    t = t.where("mark IS NULL OR window.end + INTERVAL 5 DAYS > mark").withColumn("behind", F.coalesce(F.expr("window.end <= mark"), F.lit(False)))
    running = Window.partitionBy("shard_id", "window").orderBy("txn_id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"n": F.count("*").over(running), "total": dbl(F.sum("amount").over(running).cast("decimal(14,2)"))})
    first = t.where("NOT behind").groupBy("shard_id", "window").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).withColumn("kind", F.lit("FIRST"))
    again = t.where("behind").select("shard_id", "window", "n", "total", F.lit("AGAIN").alias("kind"))
    return first.unionByName(again).select("shard_id", us("window.start").alias("window_start"), "kind", "n", "total")


# The stateful operators over rows that arrive in parts

PARTED = """WITH part AS (SELECT account_id, txn_id % 3 AS part, count(*) AS c, sum(amount) AS a FROM txn GROUP BY ALL),
  run AS (SELECT CAST(account_id AS VARCHAR) AS key, row_number() OVER w AS nth, count(*) OVER (PARTITION BY account_id) AS nths, CAST(sum(c) OVER w AS BIGINT) AS n, CAST(CAST(sum(a) OVER w AS DECIMAL(14,2)) AS DOUBLE) AS total FROM part WINDOW w AS (PARTITION BY account_id ORDER BY part))
  SELECT key, CASE nth WHEN 1 THEN '+I' ELSE '+U' END AS op, n, total FROM run UNION ALL SELECT key, '-U', n, total FROM run WHERE nth < nths"""


@query(f"SELECT * FROM ({PARTED})", name="to_datastream")
def stream_changelog(spark, d):
    """Running totals of accounts as a changelog: +I, then what is taken back (-U) and put in its place (+U)."""
    t = transactions(spark, d).select(F.col("account_id").cast("string").alias("k"), dbl(F.col("amount")).alias("amount"), (F.col("txn_id") % 3).alias("part"))
    parts = [t.where(F.col("part") == i).drop("part") for i in range(3)]
    return replay(parts, lambda rows: stateful(rows, "k", Changelog(), "None", "update"), "changes", "update").drop("batch")


@query(VELOCITY.format("CAST(account_id AS VARCHAR)", "key"))
def stream_velocity(spark, d):
    """The burst rule with state and timers in event time."""
    rows = _stream(spark, d).where("account_id IS NOT NULL").select(F.col("account_id").cast("string").alias("k"), F.format_string("%019d", "txn_id").alias("id"), dbl(F.col("amount")).alias("amount"), (us("event_time") / 1e6).alias("t"), "event_time")
    found = run_all(stateful(rows, "k", VelocityAlerts(5, 300.0, 5 * 86_400.0)), "bursts")
    return found.select("key", F.col("last_id").cast("long").alias("last_id"), "n", "severity", "total")


#: Versions and facts both wait for the watermark; it ends at the newest of all, so a later sentinel lets all facts go.
ASOF = "SELECT CAST(t.account_id AS VARCHAR) AS key, CAST(t.txn_id AS VARCHAR) AS fact, v.band AS version FROM (SELECT *, epoch_ms(event_time) AS ms FROM txn) t ASOF LEFT JOIN (SELECT account_id, epoch_ms(since) AS ms, arg_max(band, band) AS band FROM version GROUP BY ALL) v ON t.account_id = v.account_id AND t.ms >= v.ms"


@query(ASOF)
def stream_asof(spark, d):
    """Facts come before their versions and wait until the watermark has passed them. It stays behind all versions until
    they have come, however long the events last. Facts without key or time have no version and don't enter the stream."""
    ms = lambda c: (us(c) / 1000).cast("long")
    k, t = F.col("account_id").cast("string").alias("k"), transactions(spark, d)
    given = F.col("account_id").isNotNull() & F.col("event_time").isNotNull()
    facts = t.where(given).select(k, F.lit(1).alias("side"), ms("event_time").alias("t"), F.col("txn_id").cast("string").alias("payload"), "event_time")
    versions = account_versions(spark, d).where("account_id IS NOT NULL AND since IS NOT NULL").groupBy("account_id", ms("since").alias("t")).agg(F.max("band").alias("payload"), F.max("since").alias("event_time"))
    versions = versions.select(k, F.lit(0).alias("side"), "t", "payload", "event_time")
    first, last = facts.agg(F.min("event_time"), F.max("event_time")).first()
    days = max(40, 0 if first is None else (last - first).days + 2)
    end = facts.agg((F.max("event_time") + F.expr(f"INTERVAL {days + 20} DAYS")).alias("event_time")).where("event_time IS NOT NULL")
    end = end.select(F.lit("~end").alias("k"), F.lit(0).alias("side"), ms("event_time").alias("t"), F.lit("end").alias("payload"), "event_time")
    found = replay([facts, versions, end], lambda rows: stateful(rows.withWatermark("event_time", f"{days} days"), "k", AsOf()), "asof")
    rest = t.where(~given).select(k.alias("key"), F.col("txn_id").cast("string").alias("fact"), F.lit(None).cast("string").alias("version"))
    return found.select("key", "fact", "version").unionByName(rest)


LATE_WINDOWS = """WITH t AS (SELECT CAST(shard_id AS VARCHAR) AS key, txn_id % 10 = 0 AS late, epoch_ms(event_time) AS ms, epoch_ms(event_time) // 86400000 * 86400000 AS w, amount FROM txn),
  mark AS (SELECT max(ms) - 5000 AS m FROM t WHERE NOT late),
  kept AS (SELECT * FROM t, mark WHERE NOT late OR w + 6 * 86400000 > m),
  made AS (SELECT key, w, count(*) FILTER (NOT late) AS n1, sum(amount) FILTER (NOT late) AS a1, count(*) AS n2, sum(amount) AS a2 FROM kept WHERE w + 86400000 <= m GROUP BY ALL)
  SELECT key, w AS window_ms, 'FIRST' AS kind, n1 AS n, CAST(CAST(a1 AS DECIMAL(14,2)) AS DOUBLE) AS total FROM made WHERE n1 > 0
  UNION ALL SELECT key, w, CASE WHEN n1 > 0 THEN 'AGAIN' ELSE 'FIRST' END, n2, CAST(CAST(a2 AS DECIMAL(14,2)) AS DOUBLE) FROM made WHERE n2 > n1
  UNION ALL SELECT key, w, 'LATE', 1, CAST(amount AS DOUBLE) FROM t, mark WHERE late AND w + 6 * 86400000 <= m"""


@query(f"SELECT * FROM ({LATE_WINDOWS})")
def stream_late_windows(spark, d):
    """Daily windows of a shard: a tenth of the rows comes after the others; five days' lateness."""
    t = transactions(spark, d).select(F.col("shard_id").cast("string").alias("k"), (us("event_time") / 1000).cast("long").alias("t"), dbl(F.col("amount")).alias("amount"), "event_time", (F.col("txn_id") % 10 == 0).alias("late"))
    parts = [t.where(~F.col("late")).drop("late"), t.where("late").drop("late")]
    return replay(parts, lambda rows: stateful(rows.withWatermark("event_time", "5 seconds"), "k", LateWindows(86_400_000, 5 * 86_400_000), "ProcessingTime"), "late", one_batch=True).drop("batch")


@query(CLOSED_BEHIND.format(0))
def wm_punctuated(spark, d):
    """The watermark follows each part that arrives, without delay: ten days of events a part."""
    events = table(spark, d, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    days = 0 if first is None else (last - first).days + 1
    part = F.floor(F.datediff("ts", F.lit(first)) / 10)
    parts = [events.where(part == i) for i in range(days // 10 + 1)]

    def build(rows):
        made = W.tumble(transactions_of(rows).withWatermark("event_time", "0 seconds"), "event_time", "1 day").groupBy("channel", "window").agg(F.count("*").alias("txn_count"), total().alias("total_usd"))
        return W.bounds(made).select("channel", us("window_start").alias("window_start"), "txn_count", "total_usd")

    return replay(parts, build, "punctuated").drop("batch")


@query(CLOSED)
def wm_idleness(spark, d):
    """A second source that stays silent doesn't hold back the windows of the first."""
    idle = transactions_of(file_stream(spark, f"{d}/events.parquet")).where("txn_id < 0").withWatermark("event_time", "5 seconds")
    both = _stream(spark, d).unionByName(idle)
    made = W.tumble(both, "event_time", "1 day").groupBy("channel", "window").agg(F.count("*").alias("txn_count"), total().alias("total_usd"))
    return run_all(W.bounds(made).select("channel", us("window_start").alias("window_start"), "txn_count", "total_usd"), "idle", settings=NEVER_IDLE).drop("batch")


@query(f"SELECT txn_id, auth_id FROM ({INTERVAL})")
def wm_alignment(spark, d):
    """Two sources admitted ten days of event time at a time: neither runs further ahead, so the join's state is bounded."""
    from tidemill.operators import joins as J

    t = transactions(spark, d).where("channel IN ('purchase', 'view')").select("txn_id", "account_id", "channel", "event_time")
    first, last = t.agg(F.min("event_time"), F.max("event_time")).first()
    days = 0 if first is None else (last - first).days + 1
    part = F.floor(F.datediff("event_time", F.lit(first)) / 10)
    parts = [t.where(part == i) for i in range(days // 10 + 1)]

    def build(rows):
        side = lambda channel: rows.where(F.col("channel") == channel).withWatermark("event_time", "5 seconds")
        auths = side("view").select("account_id", F.col("txn_id").alias("auth_id"), F.col("event_time").alias("auth_time"))
        return J.interval(side("purchase").select("txn_id", "account_id", "event_time"), auths, "account_id", "event_time", "auth_time", "-2 HOUR", "45 HOUR").select("txn_id", "auth_id")

    return replay(parts, build, "aligned").drop("batch")


# Sinks of the driver


@query("SELECT channel, count(*) AS n FROM txn GROUP BY channel")
def snk_print(spark, d):
    """Running counts on the console and in a table."""
    from tidemill.sources import sinks

    made = transactions_of(file_stream(spark, f"{d}/events.parquet")).groupBy("channel").agg(F.count("*").alias("n"))
    return newest(run_all(made, "printed", "update", lambda path: sinks.fan_out(sinks.printed("running-total"), sinks.append(path))), ["channel"])


@query("SELECT shard_id, count(*) AS n FROM txn GROUP BY shard_id")
def snk_collect(spark, d):
    """A small result in the driver's memory."""
    from tidemill.streaming.runs import collected

    made = transactions_of(file_stream(spark, f"{d}/events.parquet")).groupBy("shard_id").agg(F.count("*").alias("n"))
    return spark.createDataFrame(collected(made, "complete"), made.schema)
