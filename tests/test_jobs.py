import time

import pytest

from tidemill.operators.enrichment import asynchronously
from tidemill.plans.job_queries import LABS, labs
from tidemill.plans.script import Script
from tidemill.sources import sinks


def test_calls_that_fail_or_take_too_long(spark):
    def call(row):
        if row["id"] == 3:
            raise ValueError
        time.sleep(2 if row["id"] == 5 else 0.01)
        return row["id"] * 2.0

    df = spark.range(20).coalesce(1)
    found = {r["id"]: r["x"] for r in asynchronously(df, call, "x", "double", 0.5, capacity=4, timeout=0.5).collect()}
    assert found == {i: 0.5 if i in (3, 5) else 2.0 * i for i in range(20)}
    assert asynchronously(df.limit(0), call, "x", "double", 0.5).collect() == []


def test_labs_by_name():
    assert list(labs("late , Tumbling")) == ["tumbling", "late"] and list(labs("")) == list(labs("all")) == list(LABS)
    with pytest.raises(ValueError, match="unknown: nothing"):
        labs("late,nothing")


def test_printed_rows_are_limited(spark, capsys):
    sinks.printed("p", 2)(spark.range(5).coalesce(1), 7)
    assert capsys.readouterr().out == "p:7> 0\np:7> 1\n"


def test_catalog_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(3).write.format("jdbc").options(url=url, dbtable="THREE").save()
    script = Script(spark)
    script.one(f"CREATE CATALOG IF NOT EXISTS books WITH ('type' = 'jdbc', 'url' = '{url}', 'driver' = 'org.apache.derby.iapi.jdbc.AutoloadedDriver')")
    assert spark.conf.get("spark.sql.catalog.books.url") == url
    with pytest.raises(ValueError, match="can be opened here"):
        script.one("CREATE CATALOG other WITH ('type' = 'unheard-of')")


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Other:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(Other(), "x")
