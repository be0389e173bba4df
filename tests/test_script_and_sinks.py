import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.plans.script import Script, statements, substitute
from tidemill.sources import sinks


def test_splitter():
    assert statements("SELECT ';' AS a; -- x;y\nSELECT 1 /* ; */ + 2;;\nSELECT 'it''s -- no'") == ["SELECT ';' AS a", "SELECT 1   + 2", "SELECT 'it''s -- no'"]


def test_substitution():
    assert substitute("${A} ${B:-x} ${C:-}", {"A": "1"}) == "1 x "
    with pytest.raises(ValueError, match="Z"):
        substitute("${Z}", {})


def test_script_end_to_end(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1, 10)
    rows = [("t1", "a1", 10.0, t0), ("t2", "a1", 20.0, t0 + dt.timedelta(seconds=20)), ("t3", "a2", 30.0, t0 + dt.timedelta(seconds=70))]
    spark.createDataFrame(rows, "txn_id string, account_id string, amount double, event_time timestamp").write.parquet(f"{tmp_path}/txn")
    spark.createDataFrame([("a1", "WEST", t0 + dt.timedelta(seconds=10))], "account_id string, region string, updated_at timestamp").write.parquet(f"{tmp_path}/acc")
    text = """
    SET 'table.local-time-zone' = 'UTC';
    CREATE TABLE transactions (txn_id STRING, account_id STRING, amount DOUBLE, event_time TIMESTAMP(3), WATERMARK FOR event_time AS event_time - INTERVAL '5' SECOND) WITH ('connector' = 'filesystem', 'path' = '${DIR}/txn');
    CREATE TABLE accounts (account_id STRING, region STRING, updated_at TIMESTAMP(3), PRIMARY KEY (account_id) NOT ENFORCED, WATERMARK FOR updated_at AS updated_at - INTERVAL '1' SECOND) WITH ('connector' = 'filesystem', 'path' = '${DIR}/acc');
    CREATE TABLE sink (region STRING, window_start TIMESTAMP(3), n BIGINT) WITH ('connector' = 'filesystem', 'path' = '${DIR}/out', 'mode' = 'sink');
    CREATE TEMPORARY VIEW joined AS SELECT t.txn_id, t.amount, t.event_time, COALESCE(a.region, 'UNKNOWN') AS region FROM transactions AS t LEFT JOIN accounts FOR SYSTEM_TIME AS OF t.event_time AS a ON t.account_id = a.account_id;
    SELECT 1;
    INSERT INTO sink SELECT region, window_start, COUNT(*) AS n FROM TABLE(TUMBLE(TABLE joined, DESCRIPTOR(event_time), INTERVAL '1' MINUTE)) GROUP BY region, window_start, window_end;
    """
    out = Script(spark).run(text, {"DIR": str(tmp_path)})["sink"]
    assert sorted((r["region"], r["n"]) for r in out.collect()) == [("UNKNOWN", 1), ("UNKNOWN", 1), ("WEST", 1)]
    with pytest.raises(ValueError, match="INSERT"):
        Script(spark).run("SELECT 1", {})


def test_upsert_partial_and_ignore(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k int, a string, b string, t int")
    full, part, ignore = f"{tmp_path}/full", f"{tmp_path}/part", f"{tmp_path}/ignore"
    both = sinks.fan_out(sinks.upsert(full, ["k"], "t"), sinks.upsert(part, ["k"], "t", only=["b", "t"]), sinks.insert_ignore(ignore, ["k"]))
    both(make([(1, "x", "x", 1), (2, "y", "y", 1)]), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        both(make([(1, "z", "z", 2), (1, "w", "w", 3), (3, "n", "n", 1)]), 1)
    rows = lambda p: sorted(tuple(r) for r in sinks.read_keyed(spark, p).select("k", "a", "b", "t").collect())
    assert rows(full) == [(1, "w", "w", 3), (2, "y", "y", 1), (3, "n", "n", 1)]
    assert rows(part) == [(1, "x", "w", 3), (2, "y", "y", 1), (3, "n", "n", 1)]
    assert sorted(r["k"] for r in spark.read.parquet(ignore).collect()) == [1, 2, 3]


def test_sink_checks_and_secrets(spark, tmp_path):
    with pytest.raises(ValueError, match="append-only"):
        sinks.check_append_only(spark.range(1).withColumn("_op", F.lit("+I")))
    with pytest.raises(ValueError, match="secrets"):
        sinks.warehouse_url("acc", password="x")
    with pytest.raises(ValueError, match="account"):
        sinks.warehouse_url(None)
    assert sinks.warehouse_url("acc", url="jdbc:x") == "jdbc:x" and sinks.warehouse_url("acc", db="d").endswith("?db=d")
    (tmp_path / "s").write_text("hidden\n")
    assert sinks.secret("TOKEN", {"TOKEN_FILE": str(tmp_path / "s")}) == "hidden"


def test_match_recognize_by_brute_force(spark):
    """Incremental matching against matching with all rows at hand, and SQL's nulls in conditions."""
    import random

    from tidemill.operators.patterns import Incremental
    from tidemill.plans import match_sql

    r = random.Random(3)
    for text in ("a b{2,}?", "a+ b", "a b? c", "a{1,2} b{2}", "a* b"):
        defines = {"a": match_sql.Condition("a.v <= 5 OR a.v IS NULL"), "b": match_sql.Condition("b.v > COALESCE(LAST(b.v, 1), LAST(a.v), 0)"), "c": match_sql.Condition("NOT c.v = 3")}
        found = match_sql.pattern(text, defines, 30.0)
        for _ in range(60):
            rows, t = [], 0.0
            for i in range(r.randint(0, 25)):
                t += r.choice([0, 1, 5, 12])
                rows.append({"id": i, "v": r.choice([None, 1, 3, 5, 7, 9]), "_t": t})
            rule, got = Incremental(found), []
            for row in rows:
                got += rule.add(row)
            got += rule.finish()
            assert got == list(found.matches(rows)), (text, rows)


@pytest.mark.parametrize(("sql", "expected"), [("1 + 2 * 3 = 7", True), ("NULL = NULL", False), ("NULL IS NULL AND NOT FALSE", True), ("NULL OR TRUE", True), ("NOT (NULL AND TRUE)", False), ("'it''s' <> 'x'", True), ("ABS(-2) >= 2", True), ("4 / 0 IS NULL", True)])
def test_conditions(sql, expected):
    from tidemill.plans.match_sql import Condition

    assert Condition(sql)(lambda leaf: None) is expected


def test_conditions_that_are_not_understood():
    from tidemill.plans.match_sql import Condition

    for sql in ("a.b LIKE 'x'", "1 +", "FOO(1) = 1", "a.b ? 1"):
        with pytest.raises((ValueError, IndexError)):
            Condition(sql)


def test_script_with_patterns_and_a_database(spark, tmp_path):
    from tidemill.sources import jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    t0 = dt.datetime(2026, 1, 1, 10)
    rows = [(f"t{i}", "a1", float(v), t0 + dt.timedelta(seconds=20 * i)) for i, v in enumerate([1, 30, 90, 2, 50])]
    spark.createDataFrame(rows, "txn_id string, account_id string, amount double, event_time timestamp").write.parquet(f"{tmp_path}/txn")
    jdbc.execute(spark, url, 'CREATE TABLE bands ("account_id" VARCHAR(20), "band" VARCHAR(20))', "INSERT INTO bands VALUES ('a1', 'HIGH')", 'CREATE TABLE alerts ("account_id" VARCHAR(20) PRIMARY KEY, "band" VARCHAR(20), "hops" BIGINT)', "INSERT INTO alerts VALUES ('a1', 'OLD', 0)")
    text = """
    CREATE TABLE transactions (txn_id STRING, account_id STRING, amount DOUBLE, event_time TIMESTAMP(3)) WITH ('connector' = 'filesystem', 'path' = '${DIR}/txn');
    CREATE TABLE bands (account_id STRING, band STRING) WITH ('connector' = 'jdbc', 'url' = '${URL}', 'table-name' = 'bands');
    CREATE TABLE alerts (account_id STRING, band STRING, hops BIGINT, PRIMARY KEY (account_id) NOT ENFORCED) WITH ('connector' = 'jdbc', 'url' = '${URL}', 'table-name' = 'alerts', 'mode' = 'sink');
    INSERT INTO alerts SELECT m.account_id, b.band, m.hops FROM (SELECT account_id, hops FROM transactions MATCH_RECOGNIZE (PARTITION BY account_id ORDER BY event_time MEASURES COUNT(up.txn_id) AS hops ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW PATTERN (probe up{2,}?) WITHIN INTERVAL '1' MINUTE DEFINE probe AS probe.amount <= 5.00, up AS up.amount > COALESCE(LAST(up.amount, 1), LAST(probe.amount)))) AS m JOIN bands AS b ON m.account_id = b.account_id;
    """
    out = Script(spark).run(text, {"DIR": str(tmp_path), "URL": url})["alerts"]
    assert [tuple(r) for r in out.collect()] == [("a1", "HIGH", 2)]
