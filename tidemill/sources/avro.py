"""Avro binary records as Spark columns, in Arrow batches, and the five-byte frame that schema registries put before them.

Written from the public Avro specification: the optional connector modules are not installed everywhere. Unions are
of null and one other type; logical types are decimal on bytes, timestamp-millis and timestamp-micros.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Schema = dict[str, Any] | list[Any] | str
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}


def _kind(schema: Schema) -> tuple[str, Schema]:
    """The name that decides how a schema is read, and the schema with unions of null reduced to their other member."""
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1 or len(schema) != 2:
            raise ValueError(f"only unions of null and one other type are read: {schema}")
        return "union", rest[0]
    if isinstance(schema, str):
        return schema, schema
    if isinstance(schema["type"], (dict, list)):
        return _kind(schema["type"])
    return schema.get("logicalType", schema["type"]), schema


def spark_type(schema: Schema) -> T.DataType:
    kind, s = _kind(schema)
    if kind == "union":
        return spark_type(s)
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in s["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(s["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(s["values"]))
    if kind == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0))
    if kind.startswith("timestamp-"):
        return T.TimestampType()
    return T.StringType() if kind == "enum" else PLAIN[kind]


def _long(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = b[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def _put_long(n: int, out: bytearray) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _bytes(b: bytes, at: int) -> tuple[bytes, int]:
    n, at = _long(b, at)
    if n < 0 or at + n > len(b):
        raise ValueError("a length runs past the record's end")
    return b[at : at + n], at + n


def _put_bytes(x: bytes, out: bytearray) -> None:
    _put_long(len(x), out)
    out += x


def reader(schema: Schema) -> Callable[[bytes, int], tuple[Any, int]]:
    """A function from bytes and a place in them to the value there and the place after it."""
    kind, s = _kind(schema)
    if kind == "union":
        inner, null = reader(s), schema.index("null") if isinstance(schema, list) else schema["type"].index("null")

        def union(b, at):
            branch, at = _long(b, at)
            return (None, at) if branch == null else inner(b, at)

        return union
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in s["fields"]]

        def record(b, at):
            found = {}
            for name, read in fields:
                found[name], at = read(b, at)
            return found, at

        return record
    if kind in ("array", "map"):
        item = reader(s["items"] if kind == "array" else s["values"])

        def blocks(b, at):
            found = []
            while True:
                n, at = _long(b, at)
                if n == 0:
                    return found, at
                if n < 0:
                    n, (_, at) = -n, _long(b, at)
                for _ in range(n):
                    if kind == "map":
                        key, at = _bytes(b, at)
                    value, at = item(b, at)
                    found.append((key.decode(), value) if kind == "map" else value)

        return blocks
    if kind == "decimal":
        scale = s.get("scale", 0)

        def decimal(b, at):
            x, at = _bytes(b, at)
            return Decimal(int.from_bytes(x, "big", signed=True)).scaleb(-scale), at

        return decimal
    if kind.startswith("timestamp-"):
        unit = 1000 if kind == "timestamp-millis" else 1

        def time(b, at):
            n, at = _long(b, at)
            return n * unit, at

        return time
    if kind == "enum":
        return lambda b, at: (lambda n, to: (s["symbols"][n], to))(*_long(b, at))
    if kind in ("float", "double"):
        code, width = ("<f", 4) if kind == "float" else ("<d", 8)
        return lambda b, at: (struct.unpack_from(code, b, at)[0], at + width)
    if kind == "string":
        return lambda b, at: (lambda x, to: (x.decode(), to))(*_bytes(b, at))
    return {"null": lambda b, at: (None, at), "boolean": lambda b, at: (b[at] == 1, at + 1), "int": _long, "long": _long, "bytes": _bytes}[kind]


def writer(schema: Schema) -> Callable[[Any, bytearray], None]:
    kind, s = _kind(schema)
    if kind == "union":
        inner, null = writer(s), schema.index("null") if isinstance(schema, list) else schema["type"].index("null")

        def union(x, out):
            _put_long(null if x is None else 1 - null, out)
            if x is not None:
                inner(x, out)

        return union
    if kind == "record":
        fields = [(f["name"], writer(f["type"])) for f in s["fields"]]

        def record(x, out):
            for name, put in fields:
                put(x[name], out)

        return record
    if kind in ("array", "map"):
        item = writer(s["items"] if kind == "array" else s["values"])

        def blocks(x, out):
            if x:
                _put_long(len(x), out)
                for e in x:
                    if kind == "map":
                        _put_bytes(e[0].encode(), out)
                    item(e[1] if kind == "map" else e, out)
            _put_long(0, out)

        return blocks
    if kind == "decimal":
        scale = s.get("scale", 0)

        def decimal(x, out):
            n = int(x.scaleb(scale))
            _put_bytes(n.to_bytes(((n if n >= 0 else ~n).bit_length() + 8) // 8, "big", signed=True), out)

        return decimal
    if kind.startswith("timestamp-"):
        unit = dt.timedelta(milliseconds=1) if kind == "timestamp-millis" else dt.timedelta(microseconds=1)
        return lambda x, out: _put_long((x - EPOCH) // unit, out)
    if kind == "enum":
        return lambda x, out: _put_long(s["symbols"].index(x), out)
    if kind in ("float", "double"):
        code = "<f" if kind == "float" else "<d"
        return lambda x, out: out.extend(struct.pack(code, x))
    if kind == "string":
        return lambda x, out: _put_bytes(x.encode(), out)
    return {"null": lambda x, out: None, "boolean": lambda x, out: out.append(int(x)), "int": _put_long, "long": _put_long, "bytes": _put_bytes}[kind]


def decode(value: Column, schema: Schema) -> Column:
    """Records of bytes; null bytes and bytes that aren't a whole record of the schema give null."""
    kind = spark_type(schema)

    @F.arrow_udf(kind)
    def decoded(values: pa.Array) -> pa.Array:
        read, found = reader(schema), []
        for b in values.to_pylist():
            try:
                x, end = read(b, 0) if b is not None else (None, 0)
                found.append(x if b is not None and end == len(b) else None)
            except (IndexError, ValueError, OverflowError, struct.error):
                found.append(None)
        return pa.array(found, to_arrow_type(kind))

    return decoded(value)


def encode(record: Column, schema: Schema) -> Column:
    """Bytes of records whose fields are named as the schema's; a null record gives null."""

    @F.arrow_udf("binary")
    def encoded(records: pa.Array) -> pa.Array:
        put, found = writer(schema), []
        for x in records.to_pylist():
            out = bytearray()
            if x is not None:
                put(x, out)
            found.append(bytes(out) if x is not None else None)
        return pa.array(found, pa.binary())

    return encoded(record)


def frame(payload: Column, schema_id: int) -> Column:
    """A zero byte and the schema's id, then the record."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), payload)


def unframe(value: Column) -> Column:
    """The record after its frame; null where there is no whole frame."""
    return F.when((F.length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00"), F.substring(value, F.lit(6), F.greatest(F.length(value) - 5, F.lit(0))))


def schema_id(value: Column) -> Column:
    return F.when(F.length(value) >= 5, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int"))


# The transaction's record.
TRANSACTION: Schema = json.loads("""{"type": "record", "name": "Transaction", "fields": [
 {"name": "txn_id", "type": "string"}, {"name": "account_id", "type": "string"}, {"name": "merchant_id", "type": "string"},
 {"name": "amount", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}},
 {"name": "currency", "type": "string"}, {"name": "channel", "type": "string"}, {"name": "device_id", "type": ["null", "string"]},
 {"name": "geo", "type": ["null", {"type": "record", "name": "Geo", "fields": [{"name": "lat", "type": "double"}, {"name": "lon", "type": "double"}]}]},
 {"name": "tags", "type": {"type": "map", "values": "string"}}, {"name": "shard_id", "type": "int"},
 {"name": "event_time", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}""")
