"""Queries over the driver's tables, one per operator, each with the SQL that DuckDB runs for comparison.

Times are compared as microseconds since 1970 and decimals as doubles, which both engines write alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import expressions as X
from tidemill.operators import joins as J
from tidemill.operators import patterns as P
from tidemill.operators import windows as W
from tidemill.sources.tables import account_versions, accounts, table, transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WITH = """WITH txn AS (
  SELECT event_id AS txn_id, user_id AS account_id, event_id % 60 AS merchant_id, CAST(value AS DECIMAL(12,2)) AS amount, event_type AS channel,
    CAST(event_id % 12 AS INTEGER) AS shard_id, ts AS event_time, json_extract_string(props, '$.k') AS k FROM events
), account AS (
  SELECT c_custkey AS account_id, r_name AS region, c_mktsegment AS risk_band FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), version AS (
  SELECT account_id, 'B' || (txn_id % 5) AS band, event_time AS since, txn_id AS version_id FROM txn WHERE channel = 'signup'
)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = WITH + sql
        return f

    return add


def us(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def dbl(c: Column) -> Column:
    return c.cast("double")


def total(p: int = 14, s: int = 2, c: str = "amount") -> Column:
    return F.sum(c).cast(f"decimal({p},{s})").cast("double")


TOTAL = "CAST(CAST(sum(amount) AS DECIMAL(14,2)) AS DOUBLE)"
BUCKET = "time_bucket(INTERVAL '{}', event_time, TIMESTAMP '1970-01-01')"


# Sources, projections, filters and expressions


@query("SELECT txn_id, CASE WHEN amount < 25 THEN 'MICRO' WHEN amount < 250 THEN 'SMALL' WHEN amount < 2500 THEN 'MEDIUM' ELSE 'LARGE' END AS amount_band FROM txn")
def src_computed_cols(spark, d):
    return transactions(spark, d).select("txn_id", X.amount_band(F.col("amount")).alias("amount_band"))


@query("SELECT account_id, band, version_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY since DESC, version_id DESC) AS n FROM version) WHERE n = 1")
def src_upsert(spark, d):
    return J.latest_version(account_versions(spark, d), "account_id", "since", "version_id").select("account_id", "band", "version_id")


@query("SELECT * FROM (VALUES (CAST(10 AS BIGINT), CAST(1 AS BIGINT)), (20, 3)) AS t(v, w)")
def src_values(spark, d):
    return spark.sql("SELECT * FROM VALUES (10L, 1L), (20L, 3L) AS t(v, w)")


@query("SELECT txn_id, account_id AS card_account, 'CARD' AS pattern_name, CAST(2 AS BIGINT) AS hop_count FROM txn")
def proj_alias(spark, d):
    return transactions(spark, d).select("txn_id", F.col("account_id").alias("card_account"), F.lit("CARD").alias("pattern_name"), F.lit(2).cast("bigint").alias("hop_count"))


@query("SELECT txn_id, CAST(amount AS DOUBLE) / 2 AS lat FROM txn WHERE channel = 'click' AND amount IS NOT NULL")
def proj_struct_field(spark, d):
    t = transactions(spark, d).withColumn("geo", F.struct((dbl(F.col("amount")) / 2).alias("lat"), F.lit(0.0).alias("lon")))
    return t.where("channel = 'click' AND geo.lat IS NOT NULL").select("txn_id", F.col("geo.lat").alias("lat"))


@query("SELECT txn_id FROM txn WHERE channel = 'purchase' AND k IS NOT NULL")
def filter_pred(spark, d):
    return transactions(spark, d).where("channel = 'purchase' AND k IS NOT NULL").select("txn_id")


@query("SELECT txn_id FROM txn LEFT JOIN (SELECT s_suppkey AS merchant_id, s_acctbal < 0 AS watchlist, s_acctbal / 100000 AS rate FROM supplier WHERE s_suppkey % 2 = 0) r USING (merchant_id) WHERE coalesce(watchlist, FALSE) OR coalesce(rate, 0.0) > 0.02")
def filter_or_coalesce(spark, d):
    return join_lookup_all(spark, d).where(F.coalesce("watchlist", F.lit(False)) | (F.coalesce("rate", F.lit(0.0)) > 0.02)).select("txn_id")


@query("SELECT txn_id, channel, CAST(amount * 1.25 AS DECIMAL(18,6))::DOUBLE AS usd, strftime(event_time, '%Y-%m-%d') AS dt, epoch_us(event_time - INTERVAL '2' SECOND) AS low, CASE WHEN amount BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS mid, coalesce(nullif(channel, 'error'), 'UNKNOWN') AS region FROM txn")
def expr_scalar(spark, d):
    c = F.col
    return transactions(spark, d).select(
        "txn_id", "channel", dbl((c("amount") * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(18,6)")).alias("usd"), F.date_format("event_time", "yyyy-MM-dd").alias("dt"), us(c("event_time") - F.expr("INTERVAL 2 SECOND")).alias("low"),
        F.when(c("amount").between(10, 20), 1).otherwise(0).alias("mid"), F.coalesce(F.nullif(c("channel"), F.lit("error")), F.lit("UNKNOWN")).alias("region"),
    )


@query("SELECT account_id, CAST(date_diff('microsecond', min(event_time), max(event_time)) // 1000000 AS BIGINT) AS span_seconds FROM txn GROUP BY account_id")
def expr_tsdiff(spark, d):
    return transactions(spark, d).groupBy("account_id").agg(F.expr("timestampdiff(SECOND, min(event_time), max(event_time))").alias("span_seconds"))


@query("SELECT CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS masked, c_custkey FROM customer")
def udf_mask_pan(spark, d):
    return table(spark, d, "customer").select(X.mask_pan(F.col("c_name")).alias("masked"), "c_custkey")


@query("SELECT c_custkey, round(2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT c_custkey, pow(sin(radians(20.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin(radians(30.0 - lon) / 2), 2) AS a FROM (SELECT c_custkey, (c_custkey % 180) - 90.0 AS lat, (c_custkey % 360) - 180.0 AS lon FROM customer))")
def udf_haversine(spark, d):
    c = table(spark, d, "customer").withColumn("lat", F.col("c_custkey") % 180 - 90.0).withColumn("lon", F.col("c_custkey") % 360 - 180.0)
    return c.select("c_custkey", F.round(X.haversine_km(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(30.0)), 6).alias("km"))


@query("SELECT txn_id, tag.key AS k, tag.value AS v FROM (SELECT txn_id, unnest(map_entries(MAP {'k': k, 'channel': channel})) AS tag FROM txn WHERE txn_id % 3 <> 0)")
def join_lateral_inner(spark, d):
    t = transactions(spark, d).withColumn("tags", F.when(F.col("txn_id") % 3 != 0, F.create_map(F.lit("k"), "k", F.lit("channel"), "channel")))
    return t.select("txn_id", X.explode_tags(F.col("tags")).alias("k", "v"))


@query("SELECT txn_id, tag.key AS k, tag.value AS v FROM (SELECT txn_id, unnest(map_entries(MAP {'k': k, 'channel': channel})) AS tag FROM txn WHERE txn_id % 3 <> 0) UNION ALL SELECT txn_id, NULL, NULL FROM txn WHERE txn_id % 3 = 0")
def join_lateral_left(spark, d):
    t = transactions(spark, d).withColumn("tags", F.when(F.col("txn_id") % 3 != 0, F.create_map(F.lit("k"), "k", F.lit("channel"), "channel")))
    return t.select("txn_id", X.explode_tags(F.col("tags"), outer=True).alias("k", "v"))


@query("SELECT channel, sum(CASE WHEN k IS NOT NULL AND merchant_id <> 0 THEN CAST(k AS BIGINT) * merchant_id END) / CAST(sum(CASE WHEN k IS NOT NULL AND merchant_id <> 0 THEN merchant_id END) AS DOUBLE) AS weighted FROM txn GROUP BY channel")
def udaf_weighted_avg(spark, d):
    return transactions(spark, d).groupBy("channel").agg(X.weighted_avg(F.col("k").cast("bigint"), F.col("merchant_id")).alias("weighted"))


@query("SELECT txn_id, floor(least(1.0::DOUBLE, (1 - coalesce(trust, 0.0::DOUBLE)) * 0.5::DOUBLE + CASE channel WHEN 'purchase' THEN 0.35::DOUBLE WHEN 'click' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END + least(0.3::DOUBLE, CAST(amount AS DOUBLE) / 10000)) * 1000 + 0.5) / 1000 AS risk FROM (SELECT *, CASE WHEN txn_id % 4 > 0 THEN (txn_id % 4) / 4.0::DOUBLE END AS trust FROM txn)")
def async_risk_score(spark, d):
    trust = F.when(F.col("txn_id") % 4 > 0, (F.col("txn_id") % 4) / 4.0)
    return transactions(spark, d).select("txn_id", X.risk_score(F.col("channel"), F.col("amount"), trust, {"purchase": 0.35, "click": 0.15}).alias("risk"))


#: One step of the hash over 32-bit numbers held in 64 bits: the product of two fits.
_MUL = "({} * 1540483477) & 4294967295"
_WORD = _MUL.format("xor({0}, {0} >> 24)").format("(" + _MUL.format("k") + ")")
_BYTE = "CAST(ascii(substr(key, CAST({} AS BIGINT), 1)) AS BIGINT)"
MURMUR2 = f"""SELECT c_custkey, CAST((xor(g, g >> 15) & 2147483647) % 12 AS INTEGER) AS shard FROM (
  SELECT c_custkey, {_MUL.format("xor(f, f >> 13)")} AS g FROM (
    SELECT c_custkey, CASE rest WHEN 0 THEN h ELSE {_MUL.format("xor(h, tail)")} END AS f FROM (
      SELECT *, length(key) % 4 AS rest, list_sum([{_BYTE.format("length(key) - length(key) % 4 + i + 1")} << (8 * i) FOR i IN range(length(key) % 4)]) AS tail,
        list_reduce([xor(2538058380, length(key))] || [{" + ".join(f"({_BYTE.format(f'4 * i + {b + 1}')} << {8 * b})" for b in range(4))} FOR i IN range(length(key) // 4)], lambda h, k: xor({_MUL.format("h")}, {_WORD})) AS h
      FROM (SELECT c_custkey, format('acct-{{:05d}}', c_custkey) AS key FROM customer))))"""


@query(MURMUR2)
def expr_murmur2_shard(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.shard_of(F.format_string("acct-%05d", "c_custkey"), 12).alias("shard"))


# Joins

#: Seconds of event time that an as-of join deals to a task at most of one key.
SLICE = 86_400


@query("SELECT t.txn_id, v.band, coalesce(epoch_us(v.since), -1) AS since FROM txn t ASOF LEFT JOIN version v ON t.account_id = v.account_id AND t.event_time >= v.since")
def join_temporal_asof_left(spark, d):
    found = J.asof_left(transactions(spark, d).select("txn_id", "account_id", "event_time"), account_versions(spark, d), "account_id", "event_time", "since", ["band"], SLICE)
    return found.select("txn_id", "band", F.coalesce(us("version_time"), F.lit(-1)).alias("since"))


@query("SELECT t.txn_id, CAST(t.amount AS DOUBLE) AS amount, CAST(CAST(t.amount * coalesce(r.rate, CAST(1.0 AS DECIMAL(12,6))) AS DECIMAL(18,6)) AS DOUBLE) AS amount_usd, coalesce(epoch_us(r.at), -1) AS rate_as_of FROM txn t ASOF LEFT JOIN (SELECT merchant_id % 7 AS currency, max(CAST(amount AS DECIMAL(12,6))) AS rate, event_time AS at FROM txn WHERE channel = 'error' GROUP BY 1, 3) r ON t.merchant_id % 7 = r.currency AND t.event_time >= r.at")
def fx_normalized(spark, d):
    t = transactions(spark, d).withColumn("currency", F.col("merchant_id") % 7)
    rates = t.where("channel = 'error'").groupBy("currency", F.col("event_time").alias("at")).agg(F.max(F.col("amount").cast("decimal(12,6)")).alias("rate"))
    found = J.asof_left(t.select("txn_id", "currency", "amount", "event_time"), rates, "currency", "event_time", "at", ["rate"], SLICE)
    rate = F.coalesce("rate", F.lit(1).cast("decimal(12,6)"))
    return found.select("txn_id", dbl(F.col("amount")).alias("amount"), dbl((F.col("amount") * rate).cast("decimal(18,6)")).alias("amount_usd"), F.coalesce(us("version_time"), F.lit(-1)).alias("rate_as_of"))


INTERVAL = "SELECT t.txn_id, a.txn_id AS auth_id, CAST(epoch_us(a.event_time) - epoch_us(t.event_time) AS BIGINT) AS lag_us FROM (SELECT * FROM txn WHERE channel = 'purchase') t JOIN (SELECT * FROM txn WHERE channel = 'view') a ON t.account_id = a.account_id AND a.event_time BETWEEN t.event_time - INTERVAL '2' HOUR AND t.event_time + INTERVAL '45' HOUR"


@query(INTERVAL, name="join_interval_ds")
@query(INTERVAL)
def join_interval_inner(spark, d):
    t = transactions(spark, d)
    auths = t.where("channel = 'view'").select("account_id", F.col("txn_id").alias("auth_id"), F.col("event_time").alias("auth_time"))
    found = J.interval(t.where("channel = 'purchase'").select("txn_id", "account_id", "event_time"), auths, "account_id", "event_time", "auth_time", "-2 HOUR", "45 HOUR")
    return found.select("txn_id", "auth_id", (us("auth_time") - us("event_time")).alias("lag_us"))


@query("SELECT txn_id, watchlist, rate FROM txn LEFT JOIN (SELECT s_suppkey AS merchant_id, s_acctbal < 0 AS watchlist, s_acctbal / 100000 AS rate FROM supplier WHERE s_suppkey % 2 = 0) r USING (merchant_id)", name="join_lookup")
def join_lookup_all(spark, d):
    current = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("merchant_id"), (F.col("s_acctbal") < 0).alias("watchlist"), (F.col("s_acctbal") / 100000).alias("rate"))
    return J.lookup(transactions(spark, d), current, "merchant_id").select("txn_id", "watchlist", "rate")


APPROVAL = f"""SELECT t.account_id, epoch_us(t.w) AS window_start, t.txn_count, coalesce(a.approved, 0) AS approved, coalesce(a.declined, 0) AS declined
FROM (SELECT account_id, {BUCKET.format("1 day")} AS w, count(*) AS txn_count FROM txn GROUP BY 1, 2) t
LEFT JOIN (SELECT account_id, {BUCKET.format("1 day")} AS w, count(*) FILTER (WHERE channel = 'view') AS approved, count(*) FILTER (WHERE channel = 'error') AS declined FROM txn WHERE channel IN ('view', 'error') GROUP BY 1, 2) a
ON t.account_id = a.account_id AND t.w = a.w"""


@query(APPROVAL, name="agg_count_filter")
@query(APPROVAL)
def join_window_left(spark, d):
    t = W.tumble(transactions(spark, d), "event_time", "1 day")
    made = t.groupBy("account_id", "window").agg(F.count("*").alias("txn_count"))
    auths = t.where("channel IN ('view', 'error')").groupBy("account_id", "window").agg(F.count_if(F.col("channel") == "view").alias("approved"), F.count_if(F.col("channel") == "error").alias("declined"))
    found = W.bounds(J.window_left(made, auths, ["account_id"]))
    return found.select("account_id", us("window_start").alias("window_start"), "txn_count", F.coalesce("approved", F.lit(0)).alias("approved"), F.coalesce("declined", F.lit(0)).alias("declined"))


DIM = "(SELECT s_suppkey AS merchant_id, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0)"


@query(f"SELECT txn_id, name FROM txn LEFT JOIN {DIM} m USING (merchant_id)")
def join_broadcast_enrich(spark, d):
    return _enriched(spark, d)[0].select("txn_id", "name")


@query(f"SELECT CAST(merchant_id AS VARCHAR) AS record_key, 'UNKNOWN_MERCHANT' AS reason, 'MerchantEnrichment' AS stage FROM txn WHERE merchant_id NOT IN (SELECT merchant_id FROM {DIM})")
def dlq(spark, d):
    return _enriched(spark, d)[1]


def _enriched(spark, d):
    dim = table(spark, d, "supplier").where("s_suppkey % 5 != 0").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"))
    return J.enrich(transactions(spark, d), dim, "merchant_id", ["name"])


VERSIONED = "SELECT t.txn_id, coalesce(v.band, 'UNKNOWN') AS band FROM txn t LEFT JOIN (SELECT account_id, arg_max(band, {'a': since, 'b': band}) AS band FROM version GROUP BY 1) v USING (account_id)"


@query(VERSIONED, name="map_regional")
@query(VERSIONED)
def join_versioned_handmade(spark, d):
    return J.versioned(transactions(spark, d), account_versions(spark, d).select("account_id", "since", "band"), "account_id", "since", ["band"], F.lit("UNKNOWN")).select("txn_id", "band")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_regular(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("SELECT txn_id, channel FROM txn WHERE channel = 'error' UNION ALL SELECT txn_id, channel FROM txn WHERE channel = 'view'", name="connect_union_ds")
@query("SELECT txn_id, channel FROM txn WHERE channel = 'error' UNION ALL SELECT txn_id, channel FROM txn WHERE channel = 'view'")
def union_all(spark, d):
    t = transactions(spark, d).select("txn_id", "channel")
    return t.where("channel = 'error'").unionByName(t.where("channel = 'view'"))


# Aggregates


@query(f"SELECT channel, count(*) AS n, {TOTAL} AS total, CAST(sum(amount) AS DOUBLE) / count(*) AS mean, CAST(max(amount) AS DOUBLE) AS most, max(k) AS any_k FROM txn GROUP BY channel")
def agg_basic(spark, d):
    return transactions(spark, d).groupBy("channel").agg(F.count("*").alias("n"), total().alias("total"), (dbl(F.sum("amount")) / F.count("*")).alias("mean"), dbl(F.max("amount")).alias("most"), F.max("k").alias("any_k"))


@query("SELECT channel, count(DISTINCT account_id) AS accounts, count(DISTINCT shard_id) AS shards FROM txn GROUP BY channel")
def agg_count_distinct(spark, d):
    return transactions(spark, d).groupBy("channel").agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct("shard_id").alias("shards"))


@query(f"SELECT t.account_id, max(region) AS region, max(risk_band) AS risk_band, count(*) AS txn_count, {TOTAL} AS total_usd, CAST(max(amount) AS DOUBLE) AS max_usd, arg_max(merchant_id, {{'a': event_time, 'b': txn_id}}) AS last_merchant, epoch_us(max(event_time)) AS last_event_time FROM txn t LEFT JOIN account USING (account_id) GROUP BY t.account_id")
def agg_running_group(spark, d):
    t = transactions(spark, d).join(accounts(spark, d), "account_id", "left")
    last = F.max_by("merchant_id", F.struct("event_time", "txn_id"))
    return t.groupBy("account_id").agg(F.max("region").alias("region"), F.max("risk_band").alias("risk_band"), F.count("*").alias("txn_count"), total().alias("total_usd"), dbl(F.max("amount")).alias("max_usd"), last.alias("last_merchant"), us(F.max("event_time")).alias("last_event_time"))


def _stats(t: DataFrame, key: str, kind: str) -> DataFrame:
    made = W.bounds(t.groupBy(key, "window").agg(F.count("*").alias("txn_count"), dbl(X.money(F.sum("amount"))).alias("total_usd"), dbl(X.money_max(F.col("amount"))).alias("max_usd"), F.size(F.collect_set("merchant_id")).alias("distinct_merchants"), F.size(F.collect_set("channel")).alias("distinct_channels")))
    return made.select(F.col(key).cast("string").alias("key"), us("window_start").alias("window_start"), us("window_end").alias("window_end"), F.lit(kind).alias("window_kind"), "txn_count", "total_usd", "max_usd", "distinct_merchants", "distinct_channels")


STATS = "count(*) AS txn_count, CAST(CAST(coalesce(sum(amount), 0) AS DECIMAL(14,2)) AS DOUBLE) AS total_usd, CAST(greatest(max(amount), 0) AS DOUBLE) AS max_usd, CAST(count(DISTINCT merchant_id) AS INTEGER) AS distinct_merchants, CAST(count(DISTINCT channel) AS INTEGER) AS distinct_channels"
TUMBLE = f"SELECT CAST(account_id AS VARCHAR) AS key, epoch_us(w) AS window_start, epoch_us(w + INTERVAL '1 day') AS window_end, 'TUMBLE' AS window_kind, {STATS} FROM (SELECT *, {BUCKET.format('1 day')} AS w FROM txn) GROUP BY account_id, w"


@query(TUMBLE, name="agg_incremental")
@query(TUMBLE)
def win_tumble_ds(spark, d):
    return _stats(W.tumble(transactions(spark, d), "event_time", "1 day"), "account_id", "TUMBLE")


HOP = f"SELECT region AS key, epoch_us(w) AS window_start, epoch_us(w + INTERVAL '5 days') AS window_end, 'HOP' AS window_kind, {STATS} FROM (SELECT *, unnest(generate_series(0, 4)) AS n, {BUCKET.format('1 day')} - n * INTERVAL '1 day' AS w FROM (SELECT txn.*, 'REGION:' || coalesce(region, 'UNKNOWN') AS region FROM txn LEFT JOIN account USING (account_id))) GROUP BY region, w"


@query(HOP, name="agg_regional")
@query(HOP)
def win_hop(spark, d):
    t = transactions(spark, d).join(accounts(spark, d), "account_id", "left").withColumn("region", F.concat(F.lit("REGION:"), F.coalesce("region", F.lit("UNKNOWN"))))
    return _stats(W.hop(t, "event_time", "5 days", "1 day"), "region", "HOP")


@query(f"""SELECT account_id, epoch_us(min(event_time)) AS window_start, epoch_us(max(event_time) + INTERVAL '6 hours') AS window_end, count(*) AS txn_count, {TOTAL} AS total_usd FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY account_id ORDER BY event_time, txn_id) AS session FROM (
    SELECT *, CASE WHEN event_time <= lag(event_time) OVER (PARTITION BY account_id ORDER BY event_time, txn_id) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM txn)
) GROUP BY account_id, session""")
def win_session(spark, d):
    made = W.sessions(transactions(spark, d), "event_time", "6 hours", ["account_id"], F.count("*").alias("txn_count"), total().alias("total_usd"))
    return W.bounds(made).select("account_id", us("window_start").alias("window_start"), us("window_end").alias("window_end"), "txn_count", "total_usd")


@query(f"SELECT channel, epoch_us(s) AS window_start, epoch_us(s + n * INTERVAL '1 day') AS window_end, count(*) AS txn_count, {TOTAL} AS total_usd FROM (SELECT *, unnest(generate_series(CAST(floor((epoch_us(event_time) - epoch_us(s)) / 86400000000) AS BIGINT) + 1, 10)) AS n FROM (SELECT *, {BUCKET.format('10 days')} AS s FROM txn)) GROUP BY channel, s, n")
def win_cumulate(spark, d):
    made = W.cumulate(transactions(spark, d), "event_time", 86_400, 864_000).groupBy("channel", "window").agg(F.count("*").alias("txn_count"), total().alias("total_usd"))
    return W.bounds(made).select("channel", us("window_start").alias("window_start"), us("window_end").alias("window_end"), "txn_count", "total_usd")


@query("""SELECT r_name AS region, epoch_us(w) AS window_start, epoch_us(w + INTERVAL '7 days') AS window_end, strftime(w, '%Y-%m-%d') AS dt, count(*) AS txn_count, CAST(CAST(sum(amount) AS DECIMAL(14,2)) AS DOUBLE) AS total_usd,
  CAST(sum(amount) AS DOUBLE) / count(*) AS avg_usd, count(DISTINCT o_custkey) AS distinct_accounts, count(DISTINCT o_orderkey % 12) AS shards_touched
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS w FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, w""")
def win_tumble_sql(spark, d):
    """Revenue by region and week: the flagship query."""
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), F.col("o_orderdate").cast("timestamp").alias("event_time"))
    made = W.tumble(t.join(accounts(spark, d), "account_id"), "event_time", "7 days").groupBy("region", "window").agg(
        F.count("*").alias("txn_count"), total().alias("total_usd"), (dbl(F.sum("amount")) / F.count("*")).alias("avg_usd"), F.count_distinct("account_id").alias("distinct_accounts"), F.count_distinct(F.col("o_orderkey") % 12).alias("shards_touched")
    )
    return W.bounds(made).select("region", us("window_start").alias("window_start"), us("window_end").alias("window_end"), F.date_format("window_start", "yyyy-MM-dd").alias("dt"), "txn_count", "total_usd", "avg_usd", "distinct_accounts", "shards_touched")


# OVER, top-N, dedup, sort, limit

TOPN = f"SELECT epoch_us(w) AS window_start, rnk, merchant_id, total_usd, txn_count FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY total_usd DESC, merchant_id) AS rnk FROM (SELECT {BUCKET.format('1 day')} AS w, merchant_id, {TOTAL} AS total_usd, count(*) AS txn_count FROM txn GROUP BY 1, 2)) WHERE rnk <= 10"


@query(TOPN, name="over_row_number")
@query(TOPN, name="filter_rank")
@query(TOPN)
def topn_window(spark, d):
    made = W.tumble(transactions(spark, d), "event_time", "1 day").groupBy("window", "merchant_id").agg(total().alias("total_usd"), F.count("*").alias("txn_count"))
    best = W.top_n(made, ["window"], [F.desc("total_usd"), F.asc("merchant_id")], 10)
    return W.bounds(best).select(us("window_start").alias("window_start"), "rnk", "merchant_id", "total_usd", "txn_count")


@query("SELECT txn_id, account_id, channel FROM txn QUALIFY row_number() OVER (PARTITION BY account_id, channel ORDER BY event_time DESC, txn_id) = 1")
def dedup_latest(spark, d):
    return W.latest(transactions(spark, d).select("txn_id", "account_id", "channel", "event_time"), ["account_id", "channel"], [F.desc("event_time"), F.asc("txn_id")]).drop("event_time")


@query("SELECT DISTINCT ON (channel) channel, txn_id FROM txn ORDER BY channel, event_time DESC, txn_id")
def distinct_on_latest(spark, d):
    return W.latest(transactions(spark, d).select("channel", "txn_id", "event_time"), ["channel"], [F.desc("event_time"), F.asc("txn_id")]).drop("event_time")


@query(f"SELECT account_id, {TOTAL} AS total_usd FROM txn GROUP BY account_id ORDER BY total_usd DESC NULLS LAST, account_id LIMIT 50", name="topn_plain")
@query(f"SELECT account_id, {TOTAL} AS total_usd FROM txn GROUP BY account_id ORDER BY total_usd DESC NULLS LAST, account_id LIMIT 50")
def topk_limit(spark, d):
    return transactions(spark, d).groupBy("account_id").agg(total().alias("total_usd")).orderBy(F.desc_nulls_last("total_usd"), "account_id").limit(50)


@query("SELECT shard_id, channel, count(*) AS n FROM txn GROUP BY 1, 2 ORDER BY 1, 2", name="agg_group_2")
@query("SELECT shard_id, channel, count(*) AS n FROM txn GROUP BY 1, 2 ORDER BY 1, 2")
def order_multi(spark, d):
    return transactions(spark, d).groupBy("shard_id", "channel").agg(F.count("*").alias("n")).orderBy("shard_id", "channel")


@query("SELECT count(*) AS n, count(DISTINCT txn_id) AS n_distinct, epoch_us(max(event_time)) AS newest FROM txn")
def ext_dup_audit(spark, d):
    return transactions(spark, d).agg(F.count("*").alias("n"), F.count_distinct("txn_id").alias("n_distinct"), us(F.max("event_time")).alias("newest"))


@query("SELECT 'mch-' || lpad(CAST(i AS VARCHAR), 4, '0') AS merchant_id, CASE WHEN i % 7 = 0 THEN 0.035::DOUBLE + (i % 5) * 0.004::DOUBLE ELSE 0.002::DOUBLE END AS chargeback_rate, i % 13 = 0 AS watchlist FROM generate_series(0, 199) AS t(i)")
def seed_series(spark, d):
    i = F.col("id")
    return spark.range(200).select(F.concat(F.lit("mch-"), F.lpad(i.cast("string"), 4, "0")).alias("merchant_id"), F.when(i % 7 == 0, F.lit(0.035) + (i % 5) * F.lit(0.004)).otherwise(0.002).alias("chargeback_rate"), (i % 13 == 0).alias("watchlist"))


# Patterns


CARD_TESTING = """SELECT account_id, first_txn_id, last_txn_id, CAST(2 AS BIGINT) AS hop_count, total_usd, span_us FROM (
  WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY event_time, txn_id) AS rn FROM txn),
  c AS (SELECT a.account_id, a.rn, a.txn_id AS first_txn_id, e2.txn_id AS last_txn_id, CAST(a.amount + e1.amount + e2.amount AS DOUBLE) AS total_usd, CAST(epoch_us(e2.event_time) - epoch_us(a.event_time) AS BIGINT) AS span_us
    FROM n a JOIN n e1 ON a.account_id = e1.account_id AND e1.rn = a.rn + 1 JOIN n e2 ON a.account_id = e2.account_id AND e2.rn = a.rn + 2
    WHERE a.amount <= 20 AND e1.amount > a.amount AND e2.amount > e1.amount AND e2.event_time < a.event_time + INTERVAL '4 days'),
  pick AS (SELECT account_id, min(rn) AS rn FROM c GROUP BY 1 UNION ALL SELECT p.account_id, (SELECT min(c.rn) FROM c WHERE c.account_id = p.account_id AND c.rn >= p.rn + 3) FROM pick p WHERE EXISTS (SELECT 1 FROM c WHERE c.account_id = p.account_id AND c.rn >= p.rn + 3))
  SELECT c.* FROM c JOIN pick USING (account_id, rn))"""


@query(CARD_TESTING)
def mr_card_testing(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("account_id").orderBy("event_time", "txn_id")
    t = transactions(spark, d).select("account_id", "txn_id", "amount", "event_time")
    for i in (1, 2):
        t = t.withColumns({f"a{i}": F.lead("amount", i).over(w), f"t{i}": F.lead("event_time", i).over(w), f"i{i}": F.lead("txn_id", i).over(w)})
    starts = "amount <= 20 AND a1 > amount AND a2 > a1 AND t2 < event_time + INTERVAL 4 DAYS"
    t = t.withColumn("starts", F.coalesce(F.expr(starts), F.lit(False)))
    found = P.skip_past(t, "account_id", ["event_time", "txn_id"], "starts", 3)
    return found.select("account_id", F.col("txn_id").alias("first_txn_id"), F.col("i2").alias("last_txn_id"), F.lit(2).cast("bigint").alias("hop_count"), dbl(F.col("amount") + F.col("a1") + F.col("a2")).alias("total_usd"), (us("t2") - us("event_time")).alias("span_us"))


IMPOSSIBLE_TRAVEL = """SELECT account_id, first_txn_id, last_txn_id, total_usd FROM (
  WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY event_time, txn_id) AS rn FROM txn WHERE channel = 'purchase'),
  c AS (SELECT a.account_id, a.rn, a.txn_id AS first_txn_id, b.txn_id AS last_txn_id, CAST(a.amount + b.amount AS DOUBLE) AS total_usd
    FROM n a JOIN n b ON a.account_id = b.account_id AND b.rn = a.rn + 1 WHERE abs(b.txn_id % 180 - a.txn_id % 180) > 20 AND b.event_time < a.event_time + INTERVAL '2 days'),
  pick AS (SELECT account_id, min(rn) AS rn FROM c GROUP BY 1 UNION ALL SELECT p.account_id, (SELECT min(c.rn) FROM c WHERE c.account_id = p.account_id AND c.rn >= p.rn + 2) FROM pick p WHERE EXISTS (SELECT 1 FROM c WHERE c.account_id = p.account_id AND c.rn >= p.rn + 2))
  SELECT c.* FROM c JOIN pick USING (account_id, rn))"""


@query(IMPOSSIBLE_TRAVEL)
def mr_impossible_travel(spark, d):
    """Positions lie on one meridian, a degree (111.19 km) for each of txn_id % 180."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("account_id").orderBy("event_time", "txn_id")
    t = transactions(spark, d).where("channel = 'purchase'").select("account_id", "txn_id", "amount", "event_time", (F.col("txn_id") % 180 - 90.0).alias("lat"))
    t = t.withColumns({"b": F.lead("amount").over(w), "tb": F.lead("event_time").over(w), "ib": F.lead("txn_id").over(w), "lb": F.lead("lat").over(w)})
    far = X.haversine_km(F.col("lat"), F.lit(0.0), F.col("lb"), F.lit(0.0)) > 20.5 * 111.19508
    t = t.withColumn("starts", F.coalesce(far & F.expr("tb < event_time + INTERVAL 2 DAYS"), F.lit(False)))
    found = P.skip_past(t, "account_id", ["event_time", "txn_id"], "starts", 2)
    return found.select("account_id", F.col("txn_id").alias("first_txn_id"), F.col("ib").alias("last_txn_id"), dbl(F.col("amount") + F.col("b")).alias("total_usd"))


def _ordered(spark, d) -> DataFrame:
    """Rows of known accounts: a null one equals no other."""
    return transactions(spark, d).where("account_id IS NOT NULL").select("account_id", F.col("txn_id").alias("id"), dbl(F.col("amount")).alias("amount"), "channel", (us("event_time") / 1e6).alias("t"))


#: Of the purchases after a probe those above the floor and all purchases between count.
CEP = """SELECT account_id, first_id, last_id, hops, round(total, 2) AS total FROM (
  SELECT account_id, first_id, last_id, small + sum(amount) OVER w AS total, count(*) OVER w AS hops FROM (
    SELECT *, max(amount) OVER (PARTITION BY account_id, first_id ORDER BY event_time, last_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
      SELECT p.account_id, p.txn_id AS first_id, e.txn_id AS last_id, CAST(p.amount AS DOUBLE) AS small, CAST(e.amount AS DOUBLE) AS amount, e.event_time FROM txn p JOIN txn e ON p.account_id = e.account_id
      WHERE p.amount <= 5 AND e.channel = 'purchase' AND (e.event_time, e.txn_id) > (p.event_time, p.txn_id) AND e.event_time < p.event_time + INTERVAL '3 days')
  ) WHERE amount > greatest(5, coalesce(before, 5)) WINDOW w AS (PARTITION BY account_id, first_id ORDER BY event_time, last_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) WHERE hops >= 2"""


@query(CEP)
def cep_card_testing(spark, d):
    def start():
        rule = P.EscalatingSpend(lambda r: r["amount"] <= 5.0, lambda r: r["channel"] == "purchase", floor=5.0, within=3 * 86_400.0)
        return lambda r: [{"account_id": r["account_id"], "first_id": m[0]["id"], "last_id": m[-1]["id"], "hops": len(m) - 1, "total": round(sum(x["amount"] for x in m), 2)} for m in rule.add(r)]

    return P.per_key(_ordered(spark, d), "account_id", ["t", "id"], start, "account_id long, first_id long, last_id long, hops long, total double")


#: Row by row of each account: the burst's rows and sum so far, and the timers that are still to come.
VELOCITY = """SELECT {} AS {}, last_id, n, severity, round(total, 2) AS total FROM (
  WITH RECURSIVE o AS (SELECT account_id, txn_id, CAST(amount AS DOUBLE) AS amount, epoch_us(event_time) / 1e6 AS t, row_number() OVER (PARTITION BY account_id ORDER BY event_time, txn_id) AS rn FROM txn),
  s AS (
    SELECT account_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS total, []::DOUBLE[] AS timers, FALSE AS alert, CAST(0 AS BIGINT) AS last_id FROM o WHERE rn = 1
    UNION ALL
    SELECT account_id, rn, n, total, timers, n >= 5 AND total >= 300, txn_id FROM (
      SELECT account_id, rn, txn_id, had + 1 AS n, sum + amount AS total, CASE had WHEN 0 THEN list_append(kept, t + 5 * 86400.0::DOUBLE) ELSE kept END AS timers FROM (
        SELECT *, CASE WHEN due OR alert THEN 0 ELSE n END AS had, CASE WHEN due OR alert THEN 0.0 ELSE total END AS sum FROM (
          SELECT s.account_id, o.rn, o.txn_id, o.amount, o.t, s.n, s.total, s.alert, list_filter(s.timers, lambda x: x > o.t) AS kept, len(list_filter(s.timers, lambda x: x <= o.t)) > 0 AS due FROM s JOIN o ON s.account_id = o.account_id AND o.rn = s.rn + 1))))
  SELECT *, CASE WHEN total >= 600 THEN 'CRITICAL' ELSE 'WARN' END AS severity FROM s WHERE alert)"""


@query(VELOCITY.format("account_id", "account_id"))
def state_velocity(spark, d):
    def start():
        rule = P.Velocity(5, 300.0, 5 * 86_400.0)

        def step(r):
            rule.advance(r["t"])
            alert = rule.add(r)
            return [{"account_id": r["account_id"], "last_id": r["id"], "n": len(alert["txn_ids"]), "severity": alert["severity"], "total": round(alert["total"], 2)}] if alert else []

        return step

    return P.per_key(_ordered(spark, d), "account_id", ["t", "id"], start, "account_id long, last_id long, n long, severity string, total double")


# Changelogs, late rows and the whole enrichment

CHANGES = "SELECT account_id, txn_id, CASE WHEN n = 1 THEN '+I' ELSE '+U' END AS op, n, CAST(CAST(total AS DECIMAL(14,2)) AS DOUBLE) AS total FROM (SELECT *, row_number() OVER w AS n, sum(amount) OVER w AS total FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY event_time, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(CHANGES)
def to_changelog(spark, d):
    """Running totals with the kind of each change."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("account_id").orderBy("event_time", "txn_id")
    n = F.row_number().over(w)
    return transactions(spark, d).select("account_id", "txn_id", F.when(n == 1, "+I").otherwise("+U").alias("op"), n.cast("long").alias("n"), dbl(F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(14,2)")).alias("total"))


@query(f"SELECT * FROM ({CHANGES}) WHERE op = '+U'")
def filter_rowkind(spark, d):
    return to_changelog(spark, d).where("op = '+U'")


LATE = """SELECT txn_id, 'LATE_EVENT' AS reason, 'TumblingWindow(1d)' AS stage FROM (
  SELECT *, max(tm) OVER (PARTITION BY shard_id ORDER BY txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT txn_id, shard_id, CASE WHEN txn_id % 10 = 0 THEN event_time - INTERVAL '2 days' ELSE event_time END AS tm FROM txn)
) WHERE time_bucket(INTERVAL '1 day', tm, TIMESTAMP '1970-01-01') + INTERVAL '1 day' + INTERVAL '10 seconds' <= seen - INTERVAL '5 seconds'"""


@query(LATE, name="map_late_to_dlq")
@query(LATE)
def late_side_output(spark, d):
    """Rows whose window, with ten seconds' lateness, had closed at their shard's watermark (five seconds behind)."""
    shifted = F.when(F.col("txn_id") % 10 == 0, F.col("event_time") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("event_time"))
    t = W.max_before(transactions(spark, d).select("txn_id", "shard_id", shifted.alias("at")), "shard_id", "txn_id", "at", "seen")
    late = F.window("at", "1 day")["end"] + F.expr("INTERVAL 10 SECONDS") <= F.col("seen") - F.expr("INTERVAL 5 SECONDS")
    return t.where(late).select("txn_id", F.lit("LATE_EVENT").alias("reason"), F.lit("TumblingWindow(1d)").alias("stage"))


@query(f"SELECT i.txn_id, i.auth_id, coalesce(v.band, 'UNKNOWN') AS band, coalesce(c.region, 'UNKNOWN') AS region FROM ({INTERVAL}) i JOIN txn t ON i.txn_id = t.txn_id ASOF LEFT JOIN version v ON t.account_id = v.account_id AND t.event_time >= v.since LEFT JOIN account c ON t.account_id = c.account_id")
def enriched_transactions(spark, d):
    """Interval join with the answer, then the version as of the event and the account's region."""
    t = transactions(spark, d)
    auths = t.where("channel = 'view'").select("account_id", F.col("txn_id").alias("auth_id"), F.col("event_time").alias("auth_time"))
    found = J.interval(t.where("channel = 'purchase'").select("txn_id", "account_id", "event_time"), auths, "account_id", "event_time", "auth_time", "-2 HOUR", "45 HOUR")
    found = J.asof_left(found, account_versions(spark, d), "account_id", "event_time", "since", ["band"], SLICE)
    return J.lookup(found, accounts(spark, d), "account_id").select("txn_id", "auth_id", F.coalesce("band", F.lit("UNKNOWN")).alias("band"), F.coalesce("region", F.lit("UNKNOWN")).alias("region"))


@query("SELECT txn_id, strftime(event_time, '%Y-%m-%d') AS dt, CAST(amount AS DOUBLE) AS amount FROM txn")
def snk_fanout(spark, d):
    """One batch written to two sinks; what the date-partitioned one holds."""
    from tidemill.sources import sinks

    path = sinks.shared_folder(spark, "fanout")
    rows = transactions(spark, d).select("txn_id", F.date_format("event_time", "yyyy-MM-dd").alias("dt"), dbl(F.col("amount")).alias("amount"))
    sinks.fan_out(sinks.append(f"{path}/lake", ("dt",)), sinks.upsert(f"{path}/keyed", ["txn_id"], "txn_id"))(rows, 0)
    return spark.read.option("basePath", f"{path}/lake/batch=0").schema("txn_id long, amount double, dt string").parquet(f"{path}/lake/batch=0").select("txn_id", "dt", "amount")
