"""Runs of a stream over all that its source holds, written batch by batch to an idempotent sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.sources import sinks


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema that its files carry."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path}*")


#: Holds state beyond memory; transformWithState needs it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Of several sources the one furthest ahead sets the watermark: an idle one doesn't hold it back.
NEVER_IDLE = {"spark.sql.streaming.multipleWatermarkPolicy": "max"}


def _run(df: DataFrame, path: str, mode: str, write: Callable[[str], sinks.Write], one_batch: bool, settings: Mapping[str, str]) -> None:
    """Runs a stream until its source is used up, under settings that hold while it runs."""
    spark, settings = df.sparkSession, STATE_STORE | settings
    own = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = df.writeStream.outputMode(mode).foreachBatch(write(f"{path}/out")).option("checkpointLocation", f"{path}/progress").trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def _written(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """All batches' rows; a stream without any has an empty batch -1."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/out/batch=-1")
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/out")


def run_all(df: DataFrame, name: str, mode: str = "append", write: Callable[[str], sinks.Write] = sinks.append, one_batch: bool = False, settings: Mapping[str, str] = {}) -> DataFrame:
    """Runs a stream until its source is used up; the rows of all its batches, with the batch's number as `batch`.

    With `one_batch` a single batch takes all: state in processing time asks for further batches without end.
    The session's state store is RocksDB while the stream runs."""
    path = sinks.shared_folder(df.sparkSession, name)
    _run(df, path, mode, write, one_batch, settings)
    return _written(df.sparkSession, df.schema, path)


def replay(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", one_batch: bool = False, settings: Mapping[str, str] = {}) -> DataFrame:
    """Runs a stream over parts of one schema that arrive one after the other, each only once all before it are used up;
    the watermark moves between them. A run goes on from the state and progress of the one before."""
    spark, path = parts[0].sparkSession, sinks.shared_folder(parts[0].sparkSession, name)
    for i, part in enumerate(parts):
        part.write.parquet(f"{path}/in/{i:06d}")
        made = build(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in/*"))
        _run(made, path, mode, sinks.append, one_batch, settings)
    return _written(spark, made.schema, path)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an updating stream's rows the last batch's for each key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(*keys, "_r.*")


def collected(df: DataFrame, mode: str = "append") -> list[Row]:
    """A stream's rows on the driver once its source is used up; for results that are small by their nature."""
    spark, name = df.sparkSession, f"collected_{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", sinks.shared_folder(spark, name)).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        return spark.table(name).collect()
    finally:
        q.stop()
        spark.catalog.dropTempView(name)
