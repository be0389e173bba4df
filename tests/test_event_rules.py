"""As-of streams and burst rules on events that the tables of the tests don't hold, against their SQL."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from tidemill.plans import registry, stream_queries  # noqa: F401
from tidemill.streaming.state import AsOf, VelocityAlerts

PATH = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1, 10)


def differences(spark, tmp_path, name, rows):
    """Rows that only the query gives, and those that only its SQL gives; rows: event_id, ts, user_id, event_type, value."""
    if not os.path.isdir(PATH):
        pytest.skip("the tables are not here")
    spark.createDataFrame([(*r, '{"k": 1}') for r in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    for t in ("customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = sorted(map(str, (tuple(r) for r in df.collect())))
    wanted = sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()))
    assert wanted
    return [r for r in found if r not in wanted], [r for r in wanted if r not in found], len(found) - len(wanted)


class Handle:
    """A key's value and timers; counts the calls for timers."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.discard(t)


class Times:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.t

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_asof_keeps_one_timer_a_key():
    handle, rule = Handle(), AsOf()
    rule.init(handle)
    give = lambda side, ts, mark: [tuple(r) for f in rule.handleInputRows(("k",), iter([pd.DataFrame({"side": side, "t": ts, "payload": [f"{'vf'[side]}{t}" for t in ts]})]), Times(mark)) for r in f.itertuples(index=False)]
    fire = lambda mark: [tuple(r) for x in sorted(t for t in handle.timers if t <= mark) for f in rule.handleExpiredTimer(("k",), Times(mark), Times(x)) for r in f.itertuples(index=False)]
    assert give(1, [*range(500, 1000), *range(500)], 0) == [] and len(handle.timers) == 1
    assert give(0, list(range(100, 1000, 7)), 0) == [] and len(handle.timers) == 1 and handle.calls <= 3
    found = fire(600)
    assert found == [("k", f"f{t}", f"v{t - (t - 100) % 7}" if t >= 100 else None, t) for t in range(600)]
    assert handle.timers - {1} == {601} and handle.calls <= 5


def test_asof_waits_for_the_watermarks_own_millisecond():
    handle, rule = Handle(), AsOf()
    rule.init(handle)
    frame = lambda side, t: iter([pd.DataFrame({"side": [side], "t": [t], "payload": ["x"]})])
    assert not list(rule.handleInputRows(("k",), frame(1, 10), Times(10)))
    assert not list(rule.handleInputRows(("k",), frame(0, 10), Times(10)))
    assert [tuple(r) for f in rule.handleExpiredTimer(("k",), Times(11), Times(11)) for r in f.itertuples(index=False)] == [("k", "x", "x", 10)]


def test_asof_over_months_and_nulls(spark, tmp_path):
    """Versions come after all facts, so a watermark 40 days behind these would turn early ones away."""
    rows = [(i, T0 + dt.timedelta(days=2 * i), i % 2, "signup" if i % 3 == 0 else "view", 1.0) for i in range(60)]
    rows += [(100, None, 1, "view", 1.0), (101, T0, None, "view", 1.0), (102, None, 1, "signup", 1.0), (103, T0, None, "signup", 1.0)]
    assert differences(spark, tmp_path, "stream_asof", rows) == ([], [], 0)


def bursts():
    """Amounts that sum to 300 and, added one by one, to a little less; nulls of each kind."""
    less = [15.54, 101.32, 41.05, 87.26, 54.83]
    assert sum(less) == 300.0 > less[0] + less[1] + less[2] + less[3] + less[4]
    amounts = [*less, 1.25, 400.0, 50.0, 50.0, 50.0, 50.0, 100.0, 7.0]
    rows = [(i, T0 + dt.timedelta(minutes=i), 7, "view", x) for i, x in enumerate(amounts)]
    rows += [(100 + i, T0 + dt.timedelta(hours=15 * i), 8, "view", None if i == 2 else 70.0 + i) for i in range(30)]
    rows += [(200 + i, None if i < 4 else T0 + dt.timedelta(minutes=i), 9, "view", 65.0 + i) for i in range(14)]
    return rows + [(300 + i, T0 + dt.timedelta(minutes=i), None, "view", 90.0) for i in range(10)]


def test_velocity_adds_as_its_sql(spark, tmp_path):
    assert differences(spark, tmp_path, "state_velocity", bursts()) == ([], [], 0)


def test_velocity_stream_adds_as_its_sql(spark, tmp_path):
    assert differences(spark, tmp_path, "stream_velocity", bursts()) == ([], [], 0)


def test_velocity_stream_goes_on_with_a_burst():
    """The sum so far is kept between batches; one timer a key, which forgets it."""
    handle, rule = Handle(), VelocityAlerts(5, 300.0, 1000.0)
    rule.init(handle)
    amounts = [15.54, 101.32, 41.05, 87.26, 54.83, 0.5]
    found = [tuple(r) for i, x in enumerate(amounts) for f in rule.handleInputRows(("k",), iter([pd.DataFrame({"id": [f"{i}"], "amount": [x], "t": [20.0 * i + 0.0001]})]), Times(0)) for r in f.itertuples(index=False)]
    assert found == [("k", "5", 6, "WARN", 300.5)] and handle.timers == {1_000_001}
    assert not [f for x in sorted(handle.timers) for f in rule.handleExpiredTimer(("k",), Times(10**6), Times(x))] and handle.value is None
