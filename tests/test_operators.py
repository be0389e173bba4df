import datetime as dt
import random

import pytest

from tidemill.operators import joins, patterns, windows

BASE = dt.datetime(2026, 1, 1, 10)


def at(s):
    return BASE + dt.timedelta(seconds=s)


def test_asof_ties_nulls_and_order(spark):
    facts = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(10)), (3, "b", at(10)), (4, None, at(10)), (5, "a", at(30))], "id int, k string, t timestamp")
    versions = spark.createDataFrame([("a", at(10), "v1"), ("a", at(20), "v2"), (None, at(0), "no")], "k string, since timestamp, v string")
    found = {r["id"]: r["v"] for r in joins.asof_left(facts, versions, "k", "t", "since", ["v"]).collect()}
    assert found == {1: None, 2: "v1", 3: None, 4: None, 5: "v2"}


def test_asof_against_brute_force(spark):
    r = random.Random(3)
    facts = [(i, r.randrange(5), at(r.randrange(500))) for i in range(200)]
    versions = [(r.randrange(5), at(t), t) for t in r.sample(range(500), 60)]
    found = {x["id"]: x["v"] for x in joins.asof_left(spark.createDataFrame(facts, "id int, k int, t timestamp"), spark.createDataFrame(versions, "k int, since timestamp, v int"), "k", "t", "since", ["v"]).collect()}
    assert found == {i: max((v for k2, s, v in versions if k2 == k and s <= t), default=None) for i, k, t in facts}


def test_interval_bounds_are_inclusive(spark):
    left = spark.createDataFrame([("x", at(0))], "k string, t timestamp")
    right = spark.createDataFrame([("x", at(s), s) for s in (-3, -2, 0, 45, 46)], "k string, u timestamp, s int")
    assert sorted(r["s"] for r in joins.interval(left, right, "k", "t", "u", "-2 SECOND", "45 SECOND").collect()) == [-2, 0, 45]


def test_tumbling_window_rows(spark):
    rows = [("acct-1", "mch-1", 10.0, at(0)), ("acct-2", "mch-1", 5.0, at(5)), ("acct-1", "mch-2", 20.0, at(10)), ("acct-1", "mch-1", 30.0, at(20)), ("acct-1", "mch-3", 40.0, at(70))]
    df = windows.tumble(spark.createDataFrame(rows, "a string, m string, x double, t timestamp"), "t", "1 minute").groupBy("a", "window").agg({"x": "sum"})
    assert sorted((r[0], r[2]) for r in df.collect()) == [("acct-1", 40.0), ("acct-1", 60.0), ("acct-2", 5.0)]


def row(t, amount, channel="CNP", id=None):
    return {"t": t, "amount": amount, "channel": channel, "id": id if id is not None else t}


def card_testing(within=600):
    probe = patterns.Step("p", lambda r, m: r["amount"] <= 5)
    up = patterns.Step("e", lambda r, m: r["amount"] > (m["e"][-1] if m.get("e") else m["p"][-1])["amount"], 2, None, reluctant=True)
    return patterns.StrictPattern([probe, up], within)


def test_reluctant_match_skips_past_its_last_row():
    rows = [row(0, 1), row(10, 5.5), row(20, 6), row(30, 7), row(40, 2), row(50, 3), row(60, 9)]
    assert [[x["t"] for v in m.values() for x in v] for m in card_testing().matches(rows)] == [[0, 10, 20], [40, 50, 60]]
    assert not list(card_testing(20).matches(rows[:3]))


def test_greedy_tail_is_refused():
    with pytest.raises(ValueError, match="greedy"):
        patterns.StrictPattern([patterns.Step("a", lambda r, m: True), patterns.Step("b", lambda r, m: True, 2, None)])


def test_relaxed_matches_overlap():
    rule = patterns.EscalatingSpend(lambda r: r["amount"] <= 5, lambda r: True)
    found = [[x["amount"] for x in m] for r in (row(0, 2), row(1, 10), row(2, 4.5), row(3, 20), row(4, 30)) for m in rule.add(r)]
    assert found == [[2, 10, 20], [2, 10, 20, 30], [4.5, 20, 30]]


@pytest.mark.parametrize(("amounts", "severity"), [((600,) * 3, "WARN"), ((700,) * 3, "CRITICAL"), ((10,) * 6, None)])
def test_velocity(amounts, severity):
    rule = patterns.Velocity(3, 1000.0 if severity != "CRITICAL" else 1000.0)
    found = [a for i, x in enumerate(amounts) if (a := rule.add(row(i, x)))]
    assert [a["severity"] for a in found] == ([severity] if severity else [])


def test_velocity_forgets_and_keeps_stale_timers():
    rule = patterns.Velocity(3, 1000.0, 180.0)
    rule.add(row(0, 600)), rule.add(row(1, 600))
    rule.advance(240)
    assert rule.add(row(300, 600)) is None
    stale = patterns.Velocity(2, 100.0, 180.0)
    assert stale.add(row(0, 60)) is None and stale.add(row(1, 60))
    stale.add(row(100, 60))
    stale.advance(181)
    assert stale.add(row(182, 60)) is None


def test_max_before_equals_one_window(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from tidemill.operators import windows

    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, *range(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    plain = df.withColumn("m", F.max("v").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    key = lambda x: [tuple(y) for y in x.select("k", "i", "v", "m").orderBy("i").collect()]
    assert key(windows.max_before(df, "k", "i", "v", "m", 30)) == key(plain)
