"""Enrichment by calls to a service outside, several at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict[str, Any]


def asynchronously(df: DataFrame, call: Callable[[Row], Any], column: str, kind: str, fallback: Any, capacity: int = 100, timeout: float = 10.0) -> DataFrame:
    """Each row with what `call` returns for it, `fallback` where the call fails or takes over `timeout` seconds.

    A task has at most `capacity` calls under way; rows come out as they are answered, in no order. A micro-batch ends
    only when all of its rows are answered, so none passes a watermark. A call that never ends keeps its thread."""
    schema = StructType([*df.schema, *_parse_datatype_string(f"{column} {kind}")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, open_calls = ThreadPoolExecutor(capacity), {}

        def answered(most: int) -> list[Row]:
            """The rows answered or timed out by the time that at most `most` calls are open."""
            out = []
            while len(open_calls) > most:
                due = min(end for _, end in open_calls.values())
                done, _ = wait(open_calls, max(0.0, due - time.monotonic()), FIRST_COMPLETED)
                for f in [f for f, (_, end) in open_calls.items() if f in done or end <= time.monotonic()]:
                    row, _ = open_calls.pop(f)
                    f.cancel()
                    out.append(row | {column: f.result() if f in done and f.exception() is None else fallback})
            return out

        try:
            for frame in frames:
                out = []
                for row in frame.to_dict("records"):
                    out += answered(capacity - 1)
                    open_calls[pool.submit(call, row)] = (row, time.monotonic() + timeout)
                yield pd.DataFrame(out + answered(0), columns=schema.names)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, schema)
