"""Every registered query of this library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemill.plans import job_queries, registry, stream_queries, table_queries  # noqa: F401

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(PATH):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{PATH}/{f}'")
    return con


def key(row):
    return tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


#: Names that share a function are run once.
NAMES = list({(f, registry.ORACLE_SQL.get(n)): n for n, f in registry.QUERIES.items()}.values())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, PATH)
    columns, rows = sorted(df.columns), df.collect()
    if name not in registry.ORACLE_SQL:
        return
    sql = f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})"
    found = sorted(key(r[c] for c in columns) for r in rows)
    assert len(df.columns) == len(duck.execute(registry.ORACLE_SQL[name]).description)
    assert found == sorted(key(r) for r in duck.execute(sql).fetchall())
