"""Topics of a message broker. Spark's connector must be on the class path; all that needs no broker is testable without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources import avro


def source_options(servers: str, topic: str, earliest: bool = True, committed_only: bool = True, rows_per_trigger: int | None = None) -> dict[str, str]:
    """Where reading starts, whether open transactions are hidden, and the rate limit of a trigger."""
    found = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if earliest else "latest", "kafka.isolation.level": "read_committed" if committed_only else "read_uncommitted", "failOnDataLoss": "true"}
    return found | ({"maxOffsetsPerTrigger": str(rows_per_trigger)} if rows_per_trigger else {})


def parsed(raw: DataFrame, schema: avro.Schema) -> tuple[DataFrame, DataFrame]:
    """A topic's rows (value, partition, offset, timestamp) as records with those metadata columns, and dead letters
    for values without a frame or with bytes that aren't such a record. A null value (tombstone) is in neither."""
    rows = raw.where("value IS NOT NULL").withColumn("_record", avro.decode(avro.unframe(F.col("value")), schema))
    good = rows.where("_record IS NOT NULL").select("_record.*", *[F.col(c).alias(f"meta_{c}") for c in ("partition", "offset", "timestamp")])
    dead = rows.where("_record IS NULL").select(F.concat_ws("-", "partition", "offset").alias("record_key"), F.lit("UNREADABLE").alias("reason"), F.hex("value").alias("detail"))
    return good, dead


def source(spark: SparkSession, servers: str, topic: str, schema: avro.Schema, **options) -> tuple[DataFrame, DataFrame]:
    return parsed(spark.readStream.format("kafka").options(**source_options(servers, topic, **options)).load(), schema)


def messages(df: DataFrame, key: Column, schema: avro.Schema, schema_id: int) -> DataFrame:
    """Rows as key and framed value, for a topic."""
    fields = [f["name"] for f in schema["fields"]]
    return df.select(F.encode(key.cast("string"), "UTF-8").alias("key"), avro.frame(avro.encode(F.struct(*fields), schema), schema_id).alias("value"))


def sink(df: DataFrame, servers: str, topic: str, key: Column, schema: avro.Schema, schema_id: int, checkpoint: str):
    """At least once: readers drop repeats by the record's key, or read from an idempotent table sink instead."""
    return messages(df, key, schema, schema_id).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
