"""What the operators of this subpackage share: input tables, the shared scratch folder and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: Bytes up to which a side may be broadcast (summed over its rows before each use); beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch that Spark sends to a Python worker (a larger row stands alone).
BATCH_BYTES = 4 << 20
#: Bytes of text that a Python step takes at once.
CHUNK_BYTES = 2 << 20
#: Words of 64 bits in a sieve at most: its rows then have BROADCAST_BYTES or less, by the estimate of checked_broadcast.
SIEVE_WORDS = 1 << 20
#: Has Spark remove an execution's shuffle files at its end, instead of when the driver happens to collect garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only on a local master, as in tests, one is made where
    none is set: on a cluster each machine would write to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
            root = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends, if it wasn't before."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Spark's own file system classes, so any store works."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, codec: str = "zstd", done: Sequence[DataFrame] = ()) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go with its end, as nothing reads them again: the disk holds those of one step.
    `done`: stored frames that nothing reads once df is written; their files go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    was = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if was is None else spark.conf.set(FILE_CLEANUP, was)
    for frame in done:
        discard(frame)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(frame: DataFrame) -> None:
    """Removes the files of a stored frame."""
    if path := getattr(frame, "_scratch", None):
        remove(frame.sparkSession, path)


def _width(field: StructField) -> Column:
    """Bytes of a column's value in memory, about."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    if isinstance(kind, StructType):
        return F.lit(8 + sum(64 if isinstance(f.dataType, (ArrayType, StructType, StringType)) else 8 for f in kind)) + F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return F.lit(8)


def checked_broadcast(df: DataFrame, most: int | None = None) -> DataFrame:
    """Hints a broadcast only if the rows of df (already stored) have BROADCAST_BYTES or less in memory, by their sum."""
    width = F.lit(16)
    for field in df.schema:
        width = width + _width(field)
    n = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= (BROADCAST_BYTES if most is None else most) else df


def sifted(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of df that a join with `keys` (stored, distinct) on `column` can need: all that have a match and, as a
    bit stands for many values, some others. `column` is a long that is a hash already. Put before a join that shuffles
    df, it keeps most rows without a match out of the shuffle, with a broadcast of bounded size."""
    n = keys.count()
    words = min(SIEVE_WORDS, 1 << max(0, n // 8).bit_length())
    word = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(words - 1).cast("long"))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    sieve = keys.groupBy(word(column).alias("sieve_word")).agg(F.bit_or(bit(f"`{column}`")).alias("sieve_bits"))
    return df.join(F.broadcast(sieve), (word(F.col(column)) == F.col("sieve_word")) & (F.col("sieve_bits").bitwiseAND(bit(f"`{column}`")) != 0), "left_semi")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes: Spark's default of 64 MB holds in the JVM and again in each worker.

    Workers outlive their tasks, so each gives what its task has freed back to the system at the end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(trimmed, schema)


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C library (where it can trim) to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that one slice holds about `limit` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str, limit: int = CHUNK_BYTES, column: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded size: `work` returns the output columns of a slice."""
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, column, limit):
            out = work(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip((out[f.name] for f in target), target, strict=True)], schema=target)

    return in_arrow(df, run, schema)


#: The names of Spark types that the operators' Python steps return.
ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def to_arrow(schema: str) -> pa.Schema:
    """'a long, b string' as an Arrow schema."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (part.split() for part in schema.split(","))])
