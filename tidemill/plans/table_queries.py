"""Queries over sources, sinks, single expressions, functions in SQL and scripts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import expressions as X
from tidemill.operators import joins as J
from tidemill.operators import patterns as P
from tidemill.plans.registry import CARD_TESTING, IMPOSSIBLE_TRAVEL, ORACLE_SQL, QUERIES, TOTAL, TUMBLE, dbl, query, total, us, win_tumble_ds
from tidemill.plans.script import Script
from tidemill.sources import avro, broker, sinks
from tidemill.sources.tables import account_versions, accounts, generated, table, transactions

# Sources

# The four transactions that the semantics of SQL are tested on.
TEST_ROWS = "('t1', 'acct-1', 'mch-1', 10.00, 'CARD_PRESENT', 0, TIMESTAMP '2026-01-01 10:00:00'), ('t2', 'acct-1', 'mch-2', 20.00, 'CARD_NOT_PRESENT', 3, TIMESTAMP '2026-01-01 10:00:20'), ('t3', 'acct-2', 'mch-1', 30.00, 'CARD_PRESENT', 7, TIMESTAMP '2026-01-01 10:00:40'), ('t4', 'acct-1', 'mch-3', 40.00, 'ATM', 11, TIMESTAMP '2026-01-01 10:01:10')"


def _test_rows(spark):
    return spark.sql(f"SELECT * FROM VALUES {TEST_ROWS} AS t(txn_id, account_id, merchant_id, amount, channel, shard_id, event_time)")


@query(f"SELECT txn_id, account_id, CAST(amount AS DOUBLE) AS amount, epoch_us(event_time) AS at_us FROM (VALUES {TEST_ROWS}) AS t(txn_id, account_id, merchant_id, amount, channel, shard_id, event_time)")
def src_test_rows(spark, d):
    return _test_rows(spark).select("txn_id", "account_id", dbl(F.col("amount")).alias("amount"), us("event_time").alias("at_us"))


@query("SELECT 'events.parquet' AS file, count(*) AS n, CAST(0 AS BIGINT) AS first_row, count(*) - 1 AS last_row FROM txn")
def src_metadata_cols(spark, d):
    """A file's name and its rows' places as virtual columns."""
    at = table(spark, d, "events").select("event_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return at.groupBy("file").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


RECORDS = "SELECT 't' || txn_id AS txn_id, CAST(account_id AS VARCHAR) AS account_id, CAST(amount AS DOUBLE) AS amount, coalesce(k, 'none') AS k, shard_id, epoch_us(event_time) // 1000 AS at_ms, 7 AS schema_id, txn_id AS meta_offset FROM txn"


def _records(spark, d):
    """Transactions as the entity that topics carry."""
    c = F.col
    return transactions(spark, d).select(
        F.concat(F.lit("t"), "txn_id").alias("txn_id"), c("account_id").cast("string").alias("account_id"), F.concat(F.lit("m"), "merchant_id").alias("merchant_id"), "amount", F.lit("USD").alias("currency"), "channel",
        F.when(c("txn_id") % 2 == 0, "device").alias("device_id"), F.when(c("txn_id") % 3 == 0, F.struct(F.lit(1.5).alias("lat"), F.lit(-2.5).alias("lon"))).alias("geo"),
        F.when(c("k").isNotNull(), F.create_map(F.lit("k"), "k")).otherwise(F.create_map().cast("map<string,string>")).alias("tags"), "shard_id", "event_time", c("txn_id").alias("offset"),
    )


@query(RECORDS, name="src_kafka_sql")
@query(RECORDS, name="src_kafka_avro")
@query(RECORDS, name="snk_kafka_sql")
@query(RECORDS)
def snk_kafka_avro(spark, d):
    """Rows as keyed, framed messages, and these read back as records with their topic's metadata."""
    rows = _records(spark, d)
    sent = rows.select(avro.frame(avro.encode(F.struct(*[f["name"] for f in avro.TRANSACTION["fields"]]), avro.TRANSACTION), 7).alias("value"), F.lit(0).alias("partition"), "offset", F.current_timestamp().alias("timestamp"))
    sent = sent.withColumn("schema_id", avro.schema_id(F.col("value")))
    good, _ = broker.parsed(sent, avro.TRANSACTION)
    return good.select("txn_id", "account_id", dbl(F.col("amount")).alias("amount"), F.coalesce(F.col("tags")["k"], F.lit("none")).alias("k"), "shard_id", (us("event_time") / 1000).cast("long").alias("at_ms"), F.lit(7).alias("schema_id"), "meta_offset")


@query(name="gen_facts")
def gen_facts(spark, d):
    return generated(spark, 10_000)


# Sinks: each writes the transactions and reads its table back


def _rows(spark, d):
    return transactions(spark, d).select("txn_id", "account_id", "channel", dbl(F.col("amount")).alias("amount"), us("event_time").alias("at_us"))


WRITTEN = "SELECT txn_id, account_id, channel, CAST(amount AS DOUBLE) AS amount, epoch_us(event_time) AS at_us FROM txn"


@query(WRITTEN + " QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_id DESC) = 1")
def snk_jdbc_upsert_sql(spark, d):
    """Two batches, rows of even and of odd accounts' numbers mixed; the second one runs twice."""
    path, rows = sinks.shared_folder(spark, "upsert"), _rows(spark, d)
    write = sinks.upsert(path, ["account_id"], "txn_id")
    half = rows.agg(F.percentile_approx("txn_id", 0.5)).first()[0] or 0
    write(rows.where(F.col("txn_id") <= half), 0)
    for _ in range(2):
        write(rows.where(F.col("txn_id") > half), 1)
    return sinks.read_keyed(spark, path).select("txn_id", "account_id", "channel", "amount", "at_us")


@query("SELECT txn_id, account_id, 'new' AS channel, CAST(amount AS DOUBLE) AS amount, CAST(-1 AS BIGINT) AS at_us FROM txn")
def snk_jdbc_upsert_ds(spark, d):
    """Known keys get only `channel` and `at` of later rows."""
    path, rows = sinks.shared_folder(spark, "partial"), _rows(spark, d)
    write = sinks.upsert(path, ["txn_id"], "at_us", only=["channel", "at_us"])
    write(rows, 0)
    write(rows.select("txn_id", F.lit(0).cast("long").alias("account_id"), F.lit("new").alias("channel"), F.lit(0.0).alias("amount"), F.lit(-1).cast("long").alias("at_us")), 1)
    return sinks.read_keyed(spark, path).select("txn_id", "account_id", "channel", "amount", "at_us")


def _ignore(spark, d):
    """Known keys stay as they are."""
    path, rows = sinks.shared_folder(spark, "ignore"), _rows(spark, d)
    write = sinks.insert_ignore(path, ["txn_id"])
    write(rows.where("channel = 'view'"), 0)
    for _ in range(2):
        write(rows.withColumn("amount", F.when(F.col("channel") == "view", -1.0).otherwise(F.col("amount"))), 1)
    return spark.read.parquet(path).select("txn_id", "account_id", "channel", "amount", "at_us")


query(WRITTEN, name="snk_jdbc_insert_ignore")(_ignore)
query(WRITTEN, name="snk_warehouse_merge")(_ignore)


@query(WRITTEN)
def snk_warehouse_append(spark, d):
    """A batch appended twice, repeats dropped by the reader."""
    from tidemill.operators.windows import latest

    path, rows = sinks.shared_folder(spark, "warehouse"), _rows(spark, d)
    for batch in range(2):
        sinks.append(path)(rows, batch)
    return latest(spark.read.parquet(path), ["txn_id"], [F.desc("batch")]).select("txn_id", "account_id", "channel", "amount", "at_us")


@query("SELECT txn_id, strftime(event_time, '%Y-%m-%d') AS dt, CAST(amount AS DOUBLE) AS amount FROM txn", name="ext_cluster_by")
@query("SELECT txn_id, strftime(event_time, '%Y-%m-%d') AS dt, CAST(amount AS DOUBLE) AS amount FROM txn")
def snk_iceberg(spark, d):
    """A lake table by day, sorted by account within."""
    path = sinks.shared_folder(spark, "lake")
    rows = transactions(spark, d).select("txn_id", "account_id", dbl(F.col("amount")).alias("amount"), F.date_format("event_time", "yyyy-MM-dd").alias("dt"))
    sinks.clustered(rows, path, "dt", ["account_id"])
    return spark.read.schema("txn_id long, amount double, dt string").parquet(path)


# Expressions, one each


def _scalar(name: str, column: str, sql: str, made) -> None:
    def run(spark, d):
        return transactions(spark, d).select("txn_id", made().alias(column))

    query(f"SELECT txn_id, {sql} AS {column} FROM txn", name=name)(run)


_scalar("expr_case", "mid", "CASE WHEN amount BETWEEN 10 AND 20 THEN 'MID' WHEN amount > 20 THEN 'HIGH' ELSE 'LOW' END", lambda: F.when(F.col("amount").between(10, 20), "MID").when(F.col("amount") > 20, "HIGH").otherwise("LOW"))
_scalar("expr_coalesce", "region", "coalesce(nullif(channel, 'error'), 'UNKNOWN')", lambda: F.coalesce(F.nullif("channel", F.lit("error")), F.lit("UNKNOWN")))
_scalar("expr_decimal_mul", "usd", "CAST(CAST(amount * CAST(1.085 AS DECIMAL(12,6)) AS DECIMAL(18,6)) AS DOUBLE)", lambda: dbl((F.col("amount") * F.lit(1.085).cast("decimal(12,6)")).cast("decimal(18,6)")))
_scalar("expr_date_format", "dt", "strftime(event_time, '%Y-%m-%d')", lambda: F.date_format("event_time", "yyyy-MM-dd"))
_scalar("expr_interval_arith", "near", "event_time - INTERVAL '2' SECOND BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 00:00:00' + INTERVAL '3' DAY", lambda: F.expr("event_time - INTERVAL 2 SECOND BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 3 DAY"))
_scalar("expr_bool_null", "kept", "coalesce(nullif(channel, 'error') = 'view' OR amount > 50, FALSE)", lambda: F.coalesce((F.nullif("channel", F.lit("error")) == "view") | (F.col("amount") > 50), F.lit(False)))
_scalar("snk_utc_bind", "bound", "strftime(event_time, '%Y-%m-%d %H:%M:%S')", lambda: F.date_format(F.to_utc_timestamp("event_time", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
_scalar("map_txn_row", "row", "txn_id || '|' || account_id || '|' || channel || '|' || strftime(event_time, '%Y-%m-%d %H:%M:%S')", lambda: F.concat_ws("|", F.col("txn_id").cast("string"), F.col("account_id").cast("string"), "channel", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")))


@query("SELECT channel, CAST(CAST(sum(amount) AS DECIMAL(14,2)) AS DOUBLE) AS total, round(CAST(sum(amount) AS DOUBLE) / count(amount), 3) AS mean FROM txn GROUP BY channel")
def expr_cast_decimal(spark, d):
    return transactions(spark, d).groupBy("channel").agg(total().alias("total"), F.round(dbl(F.sum("amount")) / F.count("amount"), 3).alias("mean"))


@query("SELECT channel, max(k) AS any_k, arg_max(merchant_id, {'a': event_time, 'b': txn_id}) AS last_merchant FROM txn GROUP BY channel", name="agg_max_string")
@query("SELECT channel, max(k) AS any_k, arg_max(merchant_id, {'a': event_time, 'b': txn_id}) AS last_merchant FROM txn GROUP BY channel")
def agg_last_value(spark, d):
    return transactions(spark, d).groupBy("channel").agg(F.max("k").alias("any_k"), F.max_by("merchant_id", F.struct("event_time", "txn_id")).alias("last_merchant"))


for _name in ("agg_window_finish",):
    query(TUMBLE, name=_name)(win_tumble_ds)


@query("SELECT epoch_us(event_time) AS at_us, txn_id FROM txn ORDER BY event_time DESC, txn_id LIMIT 20")
def sort_limit_adhoc(spark, d):
    return transactions(spark, d).orderBy(F.desc("event_time"), "txn_id").limit(20).select(us("event_time").alias("at_us"), "txn_id")


# Functions under their SQL names

MASKED = "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS masked FROM customer"


@query(MASKED, name="udf_register_api")
@query(MASKED)
def udf_register_sql(spark, d):
    X.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("tidemill_customer")
    return spark.sql("SELECT c_custkey, mask_pan(c_name) AS masked FROM tidemill_customer")


@query("SELECT txn_id, tag.key AS k, tag.value AS v FROM (SELECT txn_id, unnest(map_entries(MAP {'k': k, 'channel': channel})) AS tag FROM txn)")
def udtf_explode_tags(spark, d):
    transactions(spark, d).select("txn_id", F.create_map(F.lit("k"), "k", F.lit("channel"), "channel").alias("tags")).createOrReplaceTempView("tidemill_tagged")
    return spark.sql("SELECT txn_id, tag.k, tag.v FROM tidemill_tagged, LATERAL explode(tags) AS tag(k, v)")


# Joins beyond one task's key, and retention of versions

ASOF = "SELECT t.txn_id, v.band, coalesce(epoch_us(v.since), -1) AS since FROM txn t ASOF LEFT JOIN version v ON t.account_id = v.account_id AND t.event_time >= v.since"


@query(ASOF)
def join_temporal_asof_sliced(spark, d):
    """The as-of join with its keys dealt by two days as well, for hot keys."""
    found = J.asof_left(transactions(spark, d).select("txn_id", "account_id", "event_time"), account_versions(spark, d), "account_id", "event_time", "since", ["band"], slice_seconds=2 * 86_400)
    return found.select("txn_id", "band", F.coalesce(us("version_time"), F.lit(-1)).alias("since"))


@query("SELECT account_id, version_id FROM (SELECT *, rank() OVER (PARTITION BY account_id, since <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY since DESC) AS n FROM version) WHERE since > TIMESTAMP '2024-01-15 00:00:00' OR n = 1")
def topic_compaction(spark, d):
    return J.compacted(account_versions(spark, d), "account_id", "since", F.expr("TIMESTAMP '2024-01-15 00:00:00'")).select("account_id", "version_id")


@query("SELECT region, count(*) AS n, count(DISTINCT shard_id) AS shards FROM txn LEFT JOIN account USING (account_id) GROUP BY region")
def metrics(spark, d):
    """Rows pass an observer that counts them and their shards on the way."""
    seen = transactions(spark, d).observe("tidemill_seen", F.count("*").alias("rows"), F.collect_set("shard_id").alias("shards"))
    return J.lookup(seen, accounts(spark, d), "account_id").groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("shard_id").alias("shards"))


# Patterns and scripts


@query("SELECT 'acct-1' AS account_id, 't1' AS first_txn_id, 't4' AS last_txn_id, CAST(2 AS BIGINT) AS hop_count")
def mr_reluctant_ok(spark, d):
    """(a b{2,}?) over the four test rows."""
    steps = [P.Step("a", lambda r, _: True), P.Step("b", lambda r, m: r["amount"] > (m["b"] or m["a"])[-1]["amount"], 2, None, True)]

    def start():
        found = P.Incremental(P.StrictPattern(steps))
        return lambda r: [{"account_id": r["account_id"], "first_txn_id": m["a"][0]["id"], "last_txn_id": m["b"][-1]["id"], "hop_count": len(m["b"])} for m in found.add(r)]

    rows = _test_rows(spark).select("account_id", F.col("txn_id").alias("id"), dbl(F.col("amount")).alias("amount"), us("event_time").alias("t"))
    return P.per_key(rows, "account_id", ["t", "id"], start, "account_id string, first_txn_id string, last_txn_id string, hop_count long")


MATCH_CARD = """SELECT account_id, first_txn_id, last_txn_id, hop_count, CAST(total_usd AS DOUBLE) AS total_usd, span_us FROM rows_in MATCH_RECOGNIZE (
  PARTITION BY account_id
  ORDER BY event_time, txn_id
  MEASURES FIRST(probe.txn_id) AS first_txn_id, LAST(up.txn_id) AS last_txn_id, COUNT(up.txn_id) AS hop_count,
    CAST(SUM(up.amount) + FIRST(probe.amount) AS DECIMAL(14, 2)) AS total_usd,
    TIMESTAMPDIFF(MICROSECOND, FIRST(probe.event_time), LAST(up.event_time)) AS span_us
  ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW
  PATTERN (probe up{2,}?) WITHIN INTERVAL '4' DAY
  DEFINE probe AS probe.amount <= 20.00, up AS up.amount > COALESCE(LAST(up.amount, 1), LAST(probe.amount))
)"""
MATCH_TRAVEL = """SELECT account_id, first_txn_id, last_txn_id, CAST(total_usd AS DOUBLE) AS total_usd FROM (SELECT *, txn_id % 180 - 90.0D AS lat FROM rows_in WHERE channel = 'purchase') MATCH_RECOGNIZE (
  PARTITION BY account_id
  ORDER BY event_time, txn_id
  MEASURES here.txn_id AS first_txn_id, there.txn_id AS last_txn_id, CAST(here.amount + there.amount AS DECIMAL(14, 2)) AS total_usd
  ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW
  PATTERN (here there) WITHIN INTERVAL '2' DAY
  DEFINE here AS TRUE, there AS HAVERSINE_KM(here.lat, 0.0, there.lat, 0.0) > 20.5 * 111.19508
)"""


def _matched(spark, d, sql: str):
    transactions(spark, d).createOrReplaceTempView("rows_in")
    return Script(spark).query(sql)


@query(CARD_TESTING)
def mr_sql_card_testing(spark, d):
    """The clause as SQL, over all rows."""
    return _matched(spark, d, MATCH_CARD)


@query(IMPOSSIBLE_TRAVEL)
def mr_sql_impossible_travel(spark, d):
    return _matched(spark, d, MATCH_TRAVEL)


@query("SELECT 'greedy quantifiers are not allowed on the last variable (up): its match never ends' AS error")
def mr_greedy_tail_error(spark, d):
    """A pattern whose last quantifier is greedy is refused before any row is read."""
    try:
        _matched(spark, d, MATCH_CARD.replace("{2,}?", "{2,}"))
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")
    raise AssertionError("the pattern was taken")


SCRIPT = """
SET 'table.local-time-zone' = 'UTC';
CREATE TABLE orders_in (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP) WITH ('connector' = 'filesystem', 'path' = '${DIR}/orders.parquet');
CREATE TABLE weekly (window_start TIMESTAMP(3), n BIGINT, dearest DOUBLE) WITH ('connector' = 'filesystem', 'path' = '${OUT}/weekly', 'mode' = 'sink');
CREATE TABLE dear (o_orderkey BIGINT) WITH ('connector' = 'filesystem', 'path' = '${OUT}/dear', 'mode' = 'sink');
CREATE TEMPORARY VIEW priced AS SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS at_us FROM orders_in WHERE o_totalprice > ${LEAST:-1000};
SELECT COUNT(*) FROM priced;
INSERT INTO weekly SELECT window_start, COUNT(*) AS n, MAX(o_totalprice) AS dearest FROM TABLE(TUMBLE(TABLE priced, DESCRIPTOR(at_us), INTERVAL '7' DAY)) GROUP BY window_start, window_end;
INSERT INTO dear SELECT o_orderkey FROM priced;
"""
WEEKLY = "SELECT epoch_us(time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01')) AS window_start, count(*) AS n, max(o_totalprice) AS dearest FROM orders WHERE o_totalprice > 1000 GROUP BY 1"


def _ran(spark, d, text: str, sink: str):
    return Script(spark).run(text, {"DIR": d, "OUT": sinks.shared_folder(spark, "script")})[sink]


@query(WEEKLY)
def stmt_insert_set(spark, d):
    """A whole script: settings, variables, tables, a view, a stray SELECT, two INSERTs that share the view."""
    return _ran(spark, d, SCRIPT, "weekly").select(us("window_start").alias("window_start"), "n", "dearest")


SOURCE = "CREATE TABLE orders_in (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP) WITH ('connector' = 'filesystem', 'path' = '${DIR}/orders.parquet');\n"
SINK = "CREATE TABLE made ({}) WITH ('connector' = 'filesystem', 'path' = '${{OUT}}/made', 'mode' = 'sink');\n"


@query("SELECT o_orderkey, CAST(hour(o_orderdate + INTERVAL '9' HOUR) AS INTEGER) AS hour_there FROM orders")
def stmt_set(spark, d):
    """The zone that a script sets is the one that its statements read the clock in."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        return _ran(spark, d, "SET 'table.local-time-zone' = 'Asia/Tokyo';" + SOURCE + SINK.format("o_orderkey BIGINT, hour_there INT") + "INSERT INTO made SELECT o_orderkey, hour(CAST(o_orderdate AS TIMESTAMP)) AS hour_there FROM orders_in", "made")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def stmt_create_table(spark, d):
    """A source and a sink, declared with a key, a watermark and types of another dialect."""
    text = SOURCE.replace("o_orderdate TIMESTAMP)", "o_orderdate TIMESTAMP(3), WATERMARK FOR o_orderdate AS o_orderdate - INTERVAL '5' SECOND, PRIMARY KEY (o_orderkey) NOT ENFORCED)")
    return _ran(spark, d, text + SINK.format("o_custkey BIGINT NOT NULL, n BIGINT") + "INSERT INTO made SELECT o_custkey, COUNT(*) AS n FROM orders_in GROUP BY o_custkey", "made")


@query("SELECT o_custkey, sum(o_totalprice) > 100000 AS big FROM orders WHERE o_totalprice > 50000 GROUP BY o_custkey")
def stmt_create_view(spark, d):
    """A view over a view."""
    views = "CREATE TEMPORARY VIEW dear_orders AS SELECT * FROM orders_in WHERE o_totalprice > 50000;\nCREATE OR REPLACE TEMPORARY VIEW dear_sums AS SELECT o_custkey, SUM(o_totalprice) > 100000 AS big FROM dear_orders GROUP BY o_custkey;\n"
    return _ran(spark, d, SOURCE + SINK.format("o_custkey BIGINT, big BOOLEAN") + views + "INSERT INTO made SELECT o_custkey, big FROM dear_sums", "made")


@query("SELECT o_orderkey FROM orders")
def stmt_select_stray(spark, d):
    """A SELECT between the statements runs, and changes nothing."""
    return _ran(spark, d, SOURCE + SINK.format("o_orderkey BIGINT") + "SELECT COUNT(*) FROM orders_in;\nINSERT INTO made SELECT o_orderkey FROM orders_in;\nSELECT MAX(o_totalprice) FROM orders_in", "made")


@query("SELECT o_orderkey, 'a;b -- c' AS note FROM orders")
def script_split(spark, d):
    """Semicolons in quotes and comments end no statement."""
    return _ran(spark, d, "-- first; a comment\n" + SOURCE + "/* another; one */" + SINK.format("o_orderkey BIGINT, note STRING") + ";;INSERT INTO made SELECT o_orderkey, 'a;b -- c' AS note -- last; one\nFROM orders_in;", "made")


@query("SELECT o_orderkey, 'plain' AS note FROM orders WHERE o_totalprice > 1000")
def script_subst(spark, d):
    """Variables with a value, and with a default only."""
    return _ran(spark, d, SOURCE + SINK.format("o_orderkey BIGINT, note STRING") + "INSERT INTO made SELECT o_orderkey, '${NOTE:-plain}' AS note FROM orders_in WHERE o_totalprice > ${LEAST:-1000}", "made")


#: Inventory names of queries that are registered under another name.
ALIASES = {"async_udf": "async_risk_score", "agg_udaf_weighted": "udaf_weighted_avg", "agg_ddl_group_2": "agg_group_2"}
for _name, _of in ALIASES.items():
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[_of], ORACLE_SQL[_of]
