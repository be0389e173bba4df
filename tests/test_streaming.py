import datetime as dt

from pyspark.sql import functions as F

from tidemill.operators import windows
from tidemill.streaming.state import AsOf, Changelog, VelocityAlerts, split_late, stateful

T0 = dt.datetime(2026, 1, 1, 10)


def replay(spark, tmp_path, files, schema, build, name, mode="append"):
    """Runs a query over files that arrive one a trigger; returns what a memory sink holds."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [[("a", float(i), T0 + dt.timedelta(seconds=40 * i))] for i in range(5)] + [[("z", 0.0, T0 + dt.timedelta(hours=1))], [("z", 0.0, T0 + dt.timedelta(hours=2))]]
    build = lambda df: windows.tumble(df.withWatermark("t", "5 seconds"), "t", "1 minute").groupBy("k", "window").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    found = {(r["k"], r["window"]["start"], r["n"], r["s"]) for r in replay(spark, tmp_path, rows, "k string, x double, t timestamp", build, "win") if r["k"] == "a"}
    batch = {(r["k"], r["window"]["start"], r["n"], r["s"]) for r in build(spark.createDataFrame([x for f in rows for x in f], "k string, x double, t timestamp")).collect() if r["k"] == "a"}
    assert found == batch and len(found) == 3


def test_changelog(spark, tmp_path):
    found = replay(spark, tmp_path, [[("a", 1.0)], [("a", 2.5), ("b", 1.0)]], "k string, amount double", lambda df: stateful(df, "k", Changelog(), "None", "update"), "chg", "update")
    assert sorted((r["key"], r["op"], r["n"], r["total"]) for r in found) == [("a", "+I", 1, 1.0), ("a", "+U", 2, 3.5), ("a", "-U", 1, 1.0), ("b", "+I", 1, 1.0)]


def test_velocity_stream(spark, tmp_path):
    s = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    files = [[("a", f"t{i}", 600.0, s + i, T0 + dt.timedelta(seconds=i))] for i in range(3)]
    build = lambda df: stateful(df.withWatermark("event_time", "5 seconds"), "k", VelocityAlerts(3, 1000.0, 180.0))
    found = replay(spark, tmp_path, files, "k string, id string, amount double, t double, event_time timestamp", build, "vel")
    assert [(r["key"], r["last_id"], r["n"], r["severity"], r["total"]) for r in found] == [("a", "t2", 3, "WARN", 1800.0)]


def test_asof_stream(spark, tmp_path):
    ms = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    x = lambda side, s, p: ("k", side, ms + 1000 * s, p, T0 + dt.timedelta(seconds=s))
    files = [[x(1, 5, "f-early"), x(1, 20, "f20")], [x(0, 10, "v10"), x(0, 20, "v20")], [x(1, 15, "f15")], [x(0, 90, "v90")], [x(0, 100, "v100")], [x(0, 110, "v110")]]
    build = lambda df: stateful(df.withWatermark("event_time", "30 seconds"), "k", AsOf())
    found = replay(spark, tmp_path, files, "k string, side int, t long, payload string, event_time timestamp", build, "asof")
    assert {r["fact"]: r["version"] for r in found} == {"f-early": None, "f15": "v10", "f20": "v20"}


def test_late_rows_are_split(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(seconds=600))], "id int, t timestamp")
    mark = int((T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(seconds=590)).timestamp() * 1000)
    good, dead = split_late(df, "t", 60, 10, mark)
    assert [r["id"] for r in good.collect()] == [2] and [r["reason"] for r in dead.collect()] == ["LATE_EVENT"]
