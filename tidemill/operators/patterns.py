"""Sequences of rows per key: pattern matching and a burst rule.

The rules are plain Python classes over one key's rows in order, shared by the batch form (grouped, in Arrow batches) and
the streaming form. Matching needs a key's rows in sequence, so a key is one task's work.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Row = dict[str, Any]
Condition = Callable[[Row, dict[str, list[Row]]], bool]


@dataclass(frozen=True)
class Step:
    """A pattern variable: its condition, and how many rows it takes; `most` None means any number."""

    name: str
    condition: Condition
    least: int = 1
    most: int | None = 1
    reluctant: bool = False


class More(Exception):
    """Rows that haven't come decide."""


class StrictPattern:
    """Contiguous rows, one match at a time, the next one searched past the last row."""

    def __init__(self, steps: Sequence[Step], within: float | None = None, time: str = "t", inclusive: bool = False):
        last = steps[-1]
        if last.most is None and not last.reluctant:
            raise ValueError(f"greedy quantifiers are not allowed on the last variable ({last.name}): its match never ends")
        self.steps, self.within, self.time, self.inclusive = steps, within, time, inclusive

    def _fits(self, first: Row, row: Row) -> bool:
        if self.within is None:
            return True
        span = row[self.time] - first[self.time]
        return span <= self.within if self.inclusive else span < self.within

    def _match(self, rows: Sequence[Row], start: int, step: int, taken: dict[str, list[Row]], at: int, closed: bool = True) -> tuple[int, dict[str, list[Row]]] | None:
        """The end and rows of the match from `start`; with rows still to come (not `closed`), More if these decide."""
        if step == len(self.steps):
            return at, taken
        s = self.steps[step]
        own, found = list(taken.get(s.name, [])), []
        here = at
        states = [(here, own)] if s.least == 0 else []
        while s.most is None or len(own) < s.most:
            if here >= len(rows) and not closed:
                raise More
            if here >= len(rows) or not self._fits(rows[start], rows[here]) or not s.condition(rows[here], taken | {s.name: own}):
                break
            own = [*own, rows[here]]
            here += 1
            if len(own) >= s.least:
                states.append((here, own))
                if s.reluctant and (done := self._match(rows, start, step + 1, taken | {s.name: own}, here, closed)):
                    return done
        if not s.reluctant:
            for here, own in reversed(states):
                if done := self._match(rows, start, step + 1, taken | {s.name: own}, here, closed):
                    return done
        return found or None

    def matches(self, rows: Sequence[Row]) -> Iterator[dict[str, list[Row]]]:
        at = 0
        while at < len(rows):
            found = self._match(rows, at, 0, {}, at)
            if found and found[0] > at:
                yield found[1]
                at = found[0]
            else:
                at += 1


class Incremental:
    """A strict pattern over one key's rows as they come: what is held is the one match that is still open."""

    def __init__(self, pattern: StrictPattern):
        self.pattern, self.rows = pattern, []

    def _drain(self, closed: bool) -> list[dict[str, list[Row]]]:
        out = []
        while self.rows:
            try:
                found = self.pattern._match(self.rows, 0, 0, {}, 0, closed)
            except More:
                break
            if found and found[0]:
                out.append(found[1])
            del self.rows[: found[0] if found and found[0] else 1]
        return out

    def add(self, row: Row) -> list[dict[str, list[Row]]]:
        """The matches that this row decides."""
        self.rows.append(row)
        return self._drain(False)

    def finish(self) -> list[dict[str, list[Row]]]:
        """The matches that are left when no more rows come."""
        return self._drain(True)


@dataclass
class EscalatingSpend:
    """A probe, then escalations with any rows between (relaxed contiguity): every run of `least` or more escalations, each
    above the floor and all before it, within the time from the probe. Overlapping matches are all reported."""

    probe: Callable[[Row], bool]
    escalation: Callable[[Row], bool]
    floor: float = 5.0
    least: int = 2
    within: float = 600.0
    open: list[list[Row]] = field(default_factory=list)

    def add(self, row: Row) -> list[list[Row]]:
        """The matches that this row ends."""
        self.open = [m for m in self.open if row["t"] - m[0]["t"] < self.within]
        found = []
        for m in list(self.open):
            if self.escalation(row) and row["amount"] > max([self.floor, *(r["amount"] for r in m[1:])]):
                m.append(row)
                if len(m) > self.least:
                    found.append(list(m))
        if self.probe(row):
            self.open.append([row])
        return found


@dataclass
class Velocity:
    """`count` rows or more that sum to `amount` or more, within `window` of the burst's first row: an alert at once,
    CRITICAL at twice the amount. After an alert the burst starts anew. `stale` keeps the timer of a burst that ended in
    an alert, which then ends the next burst early.

    Amounts are added one by one as floats, as SQL adds them (Python's sum() corrects its rounding, which decides at the
    threshold). A burst with a null amount can't alert, one that begins without a time has no end."""

    count: int = 5
    amount: float = 2500.0
    window: float = 180.0
    stale: bool = True
    rows: list[Row] = field(default_factory=list)
    timers: list[float] = field(default_factory=list)
    total: float = 0.0

    def advance(self, t: float) -> None:
        """Event time has come to t: due timers clear the burst. The timers are in order."""
        if t == t and self.timers and self.timers[0] <= t:
            self.rows, self.total = [], 0.0
            del self.timers[: bisect_right(self.timers, t)]

    def add(self, row: Row) -> Row | None:
        if not self.rows and row["t"] == row["t"]:
            insort(self.timers, row["t"] + self.window)
        self.rows.append(row)
        self.total += row["amount"]
        if not (len(self.rows) >= self.count and self.total >= self.amount):
            return None
        alert = {"txn_ids": [r["id"] for r in self.rows], "total": self.total, "severity": "CRITICAL" if self.total >= 2 * self.amount else "WARN", "first": self.rows[0]["t"], "last": row["t"]}
        if not self.stale and alert["first"] == alert["first"]:
            self.timers.remove(alert["first"] + self.window)
        self.rows, self.total = [], 0.0
        return alert


def per_key(df: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[Row], list[Row]]], schema: str) -> DataFrame:
    """Gives each key's rows, in order and one by one, to a rule that `start` makes for the key. Only what the rule keeps
    is held, however many rows the key has: they come sorted from a shuffle that spills. Nulls are last in the order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, now = None, None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if rule is None or row[key] != now:
                    rule, now = start(), row[key]
                out += rule(row)
            yield pd.DataFrame(out, columns=names)

    names = [part.strip().split()[0] for part in schema.split(",")]
    return df.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order]).mapInPandas(run, schema)


def skip_past(df: DataFrame, key: str, order: list[str], starts: str, length: int) -> DataFrame:
    """Of a key's rows numbered in order, those starting matches of `length` rows that don't overlap, first come first
    served. Only candidate starts travel to Python, where one number per key is held, however many rows it has."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    candidates = numbered.where(F.col(starts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, 0
        for frame in frames:
            keep = []
            for k, n in zip(frame[key].tolist(), frame["_n"].tolist(), strict=True):
                if k != now:
                    now, free = k, 0
                keep.append(n >= free)
                if n >= free:
                    free = n + length
            yield frame[keep]

    return candidates.repartition(key).sortWithinPartitions(key, "_n").mapInPandas(run, candidates.schema).drop("_n")
