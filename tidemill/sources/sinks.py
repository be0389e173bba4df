"""Sinks for micro-batches. Each write is idempotent per batch id, so a batch that runs again leaves one result."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Write = Callable[[DataFrame, int], None]


def append(path: str, partitions: tuple[str, ...] = (), codec: str = "zstd") -> Write:
    """Columnar files under batch=<id>: a batch replaces only its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("compression", codec).partitionBy(*partitions).parquet(f"{path}/batch={batch}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _replace(df: DataFrame, path: str, version: int) -> None:
    """Keyed tables are written as whole versions; the newest complete one is read."""
    df.write.mode("overwrite").parquet(f"{path}/version={version:012d}")


def read_keyed(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a keyed table (before a batch, if given)."""
    if not _exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    found = sorted(p for p in found if "/version=" in p and _exists(spark, f"{p}/_SUCCESS") and (before is None or int(p.rsplit("=", 1)[1]) < before))
    return spark.read.parquet(found[-1]) if found else None


def upsert(path: str, keys: list[str], order: str, only: list[str] | None = None) -> Write:
    """Rows replace those of equal keys, the last by `order` winning; with `only`, a known key gets just these columns."""

    def write(df: DataFrame, batch: int) -> None:
        newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")
        old = read_keyed(df.sparkSession, path, batch)
        if old is None:
            _replace(newest, path, batch)
            return
        marked = newest.select(*[F.col(k) for k in keys], F.struct(*newest.columns).alias("_new"))
        both = old.select(*[F.col(k) for k in keys], F.struct(*old.columns).alias("_old")).join(marked, keys, "full")
        take = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if only is not None and c not in only else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        _replace(both.select(*[F.col(c) if c in keys else take(c).alias(c) for c in newest.columns]), path, batch)

    return write


def insert_ignore(path: str, keys: list[str]) -> Write:
    """Only rows whose key is new; the first of equal ones in a batch."""

    def write(df: DataFrame, batch: int) -> None:
        fresh = df.dropDuplicates(keys)
        spark = df.sparkSession
        if _exists(spark, path):
            old = spark.read.parquet(path).where(F.col("batch") != batch).select(*keys)
            fresh = fresh.join(old, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def fan_out(*writes: Write) -> Write:
    """One computation of the batch for all sinks."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for w in writes:
                w(df, batch)
        finally:
            df.unpersist()

    return write


def check_append_only(df: DataFrame, changes: str = "_op") -> DataFrame:
    """Refuses a changelog for an append-only sink when the plan is made."""
    if changes in df.columns:
        raise ValueError("an append-only sink can't take a changelog; aggregate per window or use an upsert sink")
    return df


def warehouse_url(account: str | None, host: str | None = None, url: str | None = None, **options: str) -> str:
    """A JDBC address from its parts; an explicit url or host wins. Secrets don't belong in it."""
    if set(options) & {"password", "token", "secret"}:
        raise ValueError("secrets come from a file or the environment, not from arguments")
    if url:
        return url
    if not (host or account):
        raise ValueError("a warehouse needs an account, a host or a url")
    base = f"jdbc:warehouse://{host or f'{account}.example.com'}/"
    return base + ("?" + "&".join(f"{k}={v}" for k, v in sorted(options.items())) if options else "")


def secret(name: str, environment: Mapping[str, str] | None = None) -> str:
    """A secret from the file that NAME_FILE names, else from NAME."""
    environment = os.environ if environment is None else environment
    if path := environment.get(f"{name}_FILE"):
        with open(path) as f:
            return f.read().strip()
    if name in environment:
        return environment[name]
    raise ValueError(f"neither {name}_FILE nor {name} is set")


def clustered(df: DataFrame, path: str, by: str, order: list[str], codec: str = "zstd") -> None:
    """A folder per value of `by`, its rows sorted, so that readers skip folders and row groups. A value's rows are
    spread over tasks by their sort keys: a hot day isn't one task's work."""
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").option("compression", codec).partitionBy(by).parquet(path)


def bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> None:
    """A table hashed by its keys: joins and aggregates on them need no shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local one only where that is unset and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def printed(prefix: str, most: int = 20) -> Write:
    """The first rows of each batch on the driver's console, each after its prefix; the sink's limit is its feature."""

    def write(df: DataFrame, batch: int) -> None:
        for row in df.limit(most).collect():
            print(f"{prefix}:{batch}> {', '.join(str(x) for x in row)}")

    return write
