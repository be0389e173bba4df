"""Stateful streaming operators on transformWithState, and their helpers."""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.patterns import Velocity


class _Kept(StatefulProcessor):
    """Keeps one JSON text per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def load(self) -> Any:
        found = self.state.get()
        return json.loads(found[0]) if found else None

    def save(self, value: Any) -> None:
        self.state.update((json.dumps(value),))

    def close(self) -> None:
        pass


class VelocityAlerts(_Kept):
    """The burst rule over a stream: rows id, amount, t (seconds) of a key, in event-time order within a batch.

    Rows move the rule's time themselves; a key's one timer, at its last burst's end, only forgets the key."""

    SCHEMA = "key string, last_id string, n long, severity string, total double"

    def __init__(self, count: int = 5, amount: float = 2500.0, window: float = 180.0):
        self.settings = (count, amount, window)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule = Velocity(*self.settings)
        rule.rows, rule.timers, rule.total = self.load() or ([], [], 0.0)
        before, found = rule.timers[-1:], []
        frame = pd.concat(list(rows)).sort_values(["t", "id"])
        for i, amount, t in zip(frame["id"].tolist(), frame["amount"].tolist(), frame["t"].tolist(), strict=True):
            rule.advance(t)
            if alert := rule.add({"id": i, "amount": amount, "t": t}):
                found.append((key[0], i, len(alert["txn_ids"]), alert["severity"], round(alert["total"], 2)))
        if rule.timers[-1:] != before:
            for t in before:
                self.handle.deleteTimer(math.ceil(t * 1000))
            for t in rule.timers[-1:]:
                self.handle.registerTimer(math.ceil(t * 1000))
        self.save((rule.rows, rule.timers, rule.total))
        if found:
            yield pd.DataFrame(found, columns=["key", "last_id", "n", "severity", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()


class AsOf(_Kept):
    """Facts wait until the watermark has passed their time, then take the newest version that is not later.

    Rows: side (0 version, 1 fact), t (ms), payload. Versions that no fact can ask for any more are dropped. A key has one
    timer, for the first of its waiting facts: whatever is due by then goes out together.
    """

    SCHEMA = "key string, fact string, version string, t long"

    def _release(self, key, state: dict, mark: int) -> Iterator[pd.DataFrame]:
        """Facts before `mark`: rows of its own millisecond may still come."""
        state["facts"].sort(key=lambda f: f[0])
        due = bisect_left(state["facts"], mark, key=lambda f: f[0])
        if due:
            known = sorted(reversed(state["versions"]), key=lambda v: v[0])  # of equal times the one that came first is last
            times = [v[0] for v in known]
            places = [bisect_right(times, t) for t, _ in state["facts"][:due]]
            out = [(key[0], fact, known[i - 1][1] if i else None, t) for i, (t, fact) in zip(places, state["facts"][:due], strict=True)]
        old = [v for v in state["versions"] if v[0] < mark]
        state["versions"] = ([max(old, key=lambda v: v[0])] if old else []) + [v for v in state["versions"] if v[0] >= mark]
        state["facts"] = state["facts"][due:]
        self._wake(state)
        self.save(state)
        if due:
            yield pd.DataFrame(out, columns=["key", "fact", "version", "t"])

    def _wake(self, state: dict) -> None:
        """Moves the timer to the first waiting fact."""
        first = state["facts"][0][0] + 1 if state["facts"] else None
        if first == state["timer"]:
            return
        if state["timer"] is not None:
            self.handle.deleteTimer(state["timer"])
        if first is not None:
            self.handle.registerTimer(first)
        state["timer"] = first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.load() or {"versions": [], "facts": [], "timer": None}
        for frame in rows:
            for side, t, payload in zip(frame["side"].tolist(), frame["t"].tolist(), frame["payload"].tolist(), strict=True):
                state["facts" if side else "versions"].append([int(t), payload])
        yield from self._release(key, state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        if state["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            state["timer"] = None  # the caller removes it
        yield from self._release(key, state, timerValues.getCurrentWatermarkInMs())


class Changelog(_Kept):
    """Running count and total of a key with the kind of each change: +I at first, then -U and +U."""

    SCHEMA = "key string, op string, n long, total double"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.load()
        n, total = old or (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), round(total + float(frame["amount"].sum()), 2)
        self.save((n, total))
        out = [(key[0], "+I", n, total)] if old is None else [(key[0], "-U", *old), (key[0], "+U", n, total)]
        yield pd.DataFrame(out, columns=["key", "op", "n", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([], columns=["key", "op", "n", "total"])


class LateWindows(_Kept):
    """Tumbling windows with allowed lateness: a window fires once the watermark has reached its end, fires anew with its
    corrected result for each batch of rows up to `lateness` after that, and then turns rows away as late ones.

    Runs in ProcessingTime mode, where rows behind the watermark still arrive; a timer looks for windows to fire. Rows:
    t (ms), amount. Held per key: count and total of the windows that may still change.
    """

    SCHEMA = "key string, window_ms long, kind string, n long, total double"

    def __init__(self, width: int = 60_000, lateness: int = 10_000, poll: int = 100):
        self.width, self.lateness, self.poll = width, lateness, poll

    def _fire(self, key, windows: dict, mark: int, changed: set[str] | None = None) -> list[tuple]:
        """Results of windows that have ended: those that haven't fired, and (given `changed`) fired ones in it."""
        out = []
        for w in sorted(windows, key=int):
            n, total, fired = windows[w]
            if int(w) + self.width <= mark and (not fired or w in (changed or ())):
                out.append((key[0], int(w), "AGAIN" if fired else "FIRST", n, round(total, 2)))
                windows[w] = (n, total, True)
        return out

    def _keep(self, windows: dict, mark: int, timerValues) -> None:
        kept = {w: x for w, x in windows.items() if int(w) + self.width + self.lateness > mark}
        self.save(kept)
        if kept:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.poll)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows, changed, late, mark = self.load() or {}, set(), [], timerValues.getCurrentWatermarkInMs()
        out = self._fire(key, windows, mark)
        for frame in rows:
            for t, amount in zip(frame["t"].tolist(), frame["amount"].tolist(), strict=True):
                w = str(t - t % self.width)
                if int(w) + self.width + self.lateness <= mark:
                    late.append((key[0], int(w), "LATE", 1, amount))
                    continue
                n, total, fired = windows.get(w, (0, 0.0, False))
                windows[w] = (n + 1, total + amount, fired)
                changed.add(w)
        out += self._fire(key, windows, mark, changed) + late
        self._keep(windows, mark, timerValues)
        yield pd.DataFrame(out, columns=["key", "window_ms", "kind", "n", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, mark = self.load() or {}, timerValues.getCurrentWatermarkInMs()
        out = self._fire(key, windows, mark)
        self._keep(windows, mark, timerValues)
        yield pd.DataFrame(out, columns=["key", "window_ms", "kind", "n", "total"])


class FirstSeen(StatefulProcessor):
    """A key's first row; the key is forgotten `ttl` ms (of processing time) after it. Rows of a batch: the least id."""

    SCHEMA = "key string, id long"

    def __init__(self, ttl: int = 3_600_000):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "id long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, fresh = min(int(frame["id"].min()) for frame in rows), not self.seen.exists()
        if fresh:
            self.seen.update((first,))
        yield pd.DataFrame([(key[0], first)] if fresh else [], columns=["key", "id"])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, key: str, processor: _Kept, time_mode: str = "EventTime", output: str = "append") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode=output, timeMode=time_mode)


def split_late(df: DataFrame, time: str, window_seconds: int, lateness_seconds: int, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """A batch's rows that can still count, and dead letters for those whose window closed at this watermark."""
    end = (F.floor(F.col(time).cast("double") / window_seconds) + 1) * window_seconds
    late = (end + lateness_seconds) * 1000 <= watermark_ms
    dead = df.where(late).select(F.expr("uuid()").alias("dlq_id"), F.lit("LATE_EVENT").alias("reason"), F.lit(f"TumblingWindow({window_seconds}s)").alias("stage"), F.col(time).alias("occurred_at"), F.to_json(F.struct(*df.columns)).alias("detail"))
    return df.where(~late), dead
