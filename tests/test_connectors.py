import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.operators import joins as J
from tidemill.sources import avro, broker, jdbc, sinks
from tidemill.streaming.state import LateWindows, stateful

T0 = dt.datetime(2026, 1, 1, 10)
URL = "jdbc:derby:memory:tidemill;create=true"


def test_avro_bytes_of_the_specification():
    out = bytearray()
    for n in (0, -1, 1, -64, 64, 2**40, -(2**63)):
        avro._put_long(n, out)
    assert bytes(out[:5]) == bytes([0, 1, 2, 127, 128])
    at, found = 0, []
    while at < len(out):
        n, at = avro._long(bytes(out), at)
        found.append(n)
    assert found == [0, -1, 1, -64, 64, 2**40, -(2**63)]
    record, out = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}, bytearray()
    avro.writer(record)({"a": 27, "b": "foo"}, out)
    assert out.hex() == "3606666f6f"
    blocks = avro.reader({"type": "array", "items": "int"})
    assert blocks(bytes([3, 4, 6, 8, 0]), 0) == ([3, 4], 5)  # a block of negative count carries its size
    with pytest.raises(ValueError, match="union"):
        avro.spark_type(["int", "string"])


def test_messages_round_trip(spark):
    rows = [("t1", "a", "m", Decimal("-1.28"), "USD", "ATM", None, None, {}, 3, T0), ("tä2", "b", "m", Decimal("12345.67"), "EUR", "WIRE", "d", (1.5, -2.5), {"k": "v", "l": ""}, -1, T0 + dt.timedelta(milliseconds=7))]
    df = spark.createDataFrame(rows, avro.spark_type(avro.TRANSACTION))
    sent = broker.messages(df, F.col("account_id"), avro.TRANSACTION, 258)
    assert {bytes(r["value"])[:5].hex() for r in sent.collect()} == {"0000000102"} and {bytes(r["key"]) for r in sent.collect()} == {b"a", b"b"}
    bad = spark.createDataFrame([(bytearray(b"k"), x) for x in (None, bytearray(), bytearray(b"\x00\x00\x00\x01\x02\x06ab"), bytearray(b"\x01\x00\x00\x01\x02"))], "key binary, value binary")
    raw = sent.unionByName(bad).withColumns({"partition": F.lit(1), "offset": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()})
    good, dead = broker.parsed(raw, avro.TRANSACTION)
    assert sorted(good.select(*df.columns).collect()) == sorted(df.collect()) and dead.count() == 3
    assert broker.source_options("b:1", "t", rows_per_trigger=5)["maxOffsetsPerTrigger"] == "5"


def test_database_upsert_and_lookup(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, a string, n int")
    columns = '("k" INT PRIMARY KEY, "a" VARCHAR(20), "n" INT)'
    jdbc.execute(spark, URL, *[f"CREATE TABLE {t} {columns}" for t in ("full_", "part_", "ignore_")])
    writes = {"full_": jdbc.upsert(URL, "full_", ["k"], "n"), "part_": jdbc.upsert(URL, "part_", ["k"], "n", only=["n"]), "ignore_": jdbc.insert_ignore(URL, "ignore_", ["k"], "n")}
    for table, write in writes.items():
        write(make([(1, "x", 1), (2, "y", 1), (None, "z", 1)]), 0)
        for _ in range(2):
            write(make([(1, "v", 2), (1, "w", 3), (3, "n", 1)]), 1)
        found = sorted(tuple(r) for r in jdbc.read(spark, URL, table, "k", (1, 3), 2).collect())
        assert found == {"full_": [(1, "w", 3), (2, "y", 1), (3, "n", 1)], "part_": [(1, "x", 3), (2, "y", 1), (3, "n", 1)], "ignore_": [(1, "x", 1), (2, "y", 1), (3, "n", 1)]}[table]
    seen = J.lookup(spark.createDataFrame([(1,), (9,)], "k int"), jdbc.read(spark, URL, "full_"), "k")
    assert sorted((r["k"], r["a"]) for r in seen.collect()) == [(1, "w"), (9, None)]
    assert jdbc.merge_sql("t", "s", ["k", "a"], ["k"], dialect="on_conflict").endswith('ON CONFLICT ("k") DO UPDATE SET "a" = EXCLUDED."a"')
    assert jdbc.merge_sql("t", "s", ["k", "a"], ["k"], only=[], dialect="on_conflict").endswith("DO NOTHING")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for t in ("left_b", "right_b"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
        sinks.bucketed(spark.range(100).withColumnRenamed("id", "k"), t, f"{tmp_path}/{t}", ["k"], 4)
    joined = spark.table("left_b").hint("merge").join(spark.table("right_b"), "k")
    assert joined.count() == 100 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for t in ("left_b", "right_b"):
        spark.sql(f"DROP TABLE {t}")


def test_sliced_asof_equals_plain(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    facts = [(i, k, at(t)) for i, (k, t) in enumerate([("a", 0), ("a", 5), ("a", 5), ("a", 61), ("a", 299), ("a", 300), ("b", 1000), ("c", 5)])] + [(90, None, at(5)), (91, "a", None)]
    versions = [("a", at(5), "v5"), ("a", at(70), "v70"), ("a", at(300), None), ("b", at(1), "b1"), (None, at(0), "none"), ("c", at(6), "late"), ("a", None, "undated")]
    f, v = spark.createDataFrame(facts, "id int, k string, t timestamp"), spark.createDataFrame(versions, "k string, since timestamp, band string")
    plain, sliced = ({r["id"]: (r["band"], r["version_time"]) for r in J.asof_left(f, v, "k", "t", "since", ["band"], s).collect()} for s in (None, 60))
    assert plain == sliced and len(plain) == 10
    assert [plain[i][0] for i in (0, 1, 2, 3, 4, 5, 6, 7, 90, 91)] == [None, "v5", "v5", "v5", "v70", None, "b1", None, None, None]
    assert J.asof_left(f.limit(0), v, "k", "t", "since", ["band"], 60).count() == 0
    kept = J.compacted(v.dropna(), "k", "since", F.lit(at(100)))
    assert sorted(r["band"] for r in kept.collect()) == ["b1", "late", "v70"]


def test_late_windows_fire_again_and_turn_rows_away(spark, tmp_path):
    s0 = int(T0.replace(tzinfo=dt.UTC).timestamp())
    files = [[("a", s, x)] for s, x in ((0, 10.0), (65, 10.0), (30, 90.0), (70, 1.0), (600, 5.0), (601, 5.0), (5, 99.0))]
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "key string, s int, amount double").select("key", "amount", ((F.lit(s0) + F.col("s")).cast("long") * 1000).alias("t"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    source = spark.readStream.schema("key string, amount double, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", "0 seconds")
    out = stateful(source, "key", LateWindows(60_000, 30_000), "ProcessingTime")
    q = out.writeStream.outputMode("append").format("memory").queryName("late_windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(120):
            found = [((r["window_ms"] // 1000 - s0), r["kind"], r["n"], r["total"]) for r in spark.table("late_windows").collect()]
            if any(k == "LATE" for _, k, _, _ in found):
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert [x for x in found if x[0] == 0] == [(0, "FIRST", 1, 10.0), (0, "AGAIN", 2, 100.0), (0, "LATE", 1, 99.0)]
    assert [x for x in found if x[0] == 60] == [(60, "FIRST", 2, 11.0)]
