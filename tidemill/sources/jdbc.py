"""Tables of a relational database: lookups, and writes that are staged by all tasks and merged by one statement.

The database runs the merge in one transaction, so a batch that runs again leaves one result and a lost executor only
costs its part of the staging table, which is rewritten for every attempt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.sinks import Write


def read(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table, read in `parts` ranges of `column` where that and its bounds are given; filters reach the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    """Statements in one transaction on the driver."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def merge_sql(target: str, staged: str, columns: list[str], keys: list[str], only: list[str] | None = None, dialect: str = "merge") -> str:
    """The statement for known keys to take `only` (None: all other columns; empty: nothing) and new ones to come in."""
    take = [c for c in (columns if only is None else only) if c not in keys]
    names = ", ".join(map(quoted, columns))
    if dialect == "on_conflict":
        sets = ", ".join(f"{quoted(c)} = EXCLUDED.{quoted(c)}" for c in take)
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {staged} ON CONFLICT ({', '.join(map(quoted, keys))}) DO " + (f"UPDATE SET {sets}" if take else "NOTHING")
    on = " AND ".join(f"{target}.{quoted(k)} = {staged}.{quoted(k)}" for k in keys)
    matched = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{quoted(c)} = {staged}.{quoted(c)}' for c in take)} " if take else ""
    return f"MERGE INTO {target} USING {staged} ON {on} {matched}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f'{staged}.{quoted(c)}' for c in columns)})"


def upsert(url: str, table: str, keys: list[str], order: str, only: list[str] | None = None, dialect: str = "merge", rows: int = 500, **options: str) -> Write:
    """Rows replace those of equal keys, the last by `order` of a batch winning; `only` as in merge_sql. Null keys are
    left out, as a primary key takes none."""

    def write(df: DataFrame, batch: int) -> None:
        present = df.dropna(subset=keys)
        columns = [c for c in df.columns if c != "_order"]
        newest = present.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select("_r.*")
        staged = f"{table}_stage_{uuid.uuid4().hex[:12]}"  # of its own, so that writers don't meet
        newest.write.format("jdbc").options(url=url, dbtable=staged, batchsize=str(rows), **options).mode("overwrite").save()
        try:
            execute(df.sparkSession, url, merge_sql(table, staged, columns, keys, only, dialect))
        finally:
            execute(df.sparkSession, url, f"DROP TABLE {staged}")

    return write


def insert_ignore(url: str, table: str, keys: list[str], order: str, **options: str) -> Write:
    """Only rows whose key is new."""
    return upsert(url, table, keys, order, only=[], **options)
