"""MATCH_RECOGNIZE in SQL: strictly contiguous patterns, one row a match, the next match past the last row.

The clause is compiled to a StrictPattern: DEFINE conditions become functions of a row and of the rows taken so far, with
SQL's nulls. A match carries the values that MEASURES name (FIRST, LAST, COUNT, SUM, MIN, MAX, AVG of a variable's
column); the expressions around them are Spark SQL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FractionalType, IntegralType, LongType, StructField, StructType

from tidemill.operators.patterns import Incremental, Step, StrictPattern

CLAUSE = re.compile(r"\s*PARTITION\s+BY\s+(.*?)\s+ORDER\s+BY\s+(.*?)\s+MEASURES\s+(.*?)\s+ONE\s+ROW\s+PER\s+MATCH\s+AFTER\s+MATCH\s+SKIP\s+PAST\s+LAST\s+ROW\s+PATTERN\s*\((.*?)\)\s*(?:WITHIN\s+INTERVAL\s+'(\d+)'\s+(\w+)\s+)?DEFINE\s+(.*)", re.I | re.S)
ELEMENT = re.compile(r"(\w+)\s*(?:\{\s*(\d+)\s*(,?)\s*(\d*)\s*\}|([*+?]))?(\?)?")
LEAF = re.compile(r"\b(?:(FIRST|LAST|COUNT|SUM|MIN|MAX|AVG)\s*\(\s*(\w+)\.(\w+)\s*(?:,\s*(\d+)\s*)?\)|(\w+)\.(\w+)\b(?!\s*\())", re.I)
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*)|'((?:[^']|'')*)'|([A-Za-z_]\w*)|(<>|!=|<=|>=|[-+*/=<>(),.]))", re.S)
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}

Leaf = tuple[str, str, str, int]
Value = Callable[[Callable[[Leaf], Any]], Any]


def split(text: str) -> list[str]:
    """Parts between commas that aren't in brackets or quotes."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(text[start:i].strip())
                start = i + 1
    return [*parts, text[start:].strip()]


def closing(text: str, start: int) -> int:
    """The place of the bracket that closes the one at `start`."""
    depth, quoted = 0, False
    for i in range(start, len(text)):
        if text[i] == "'":
            quoted = not quoted
        elif not quoted:
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return i
    raise ValueError("a bracket is not closed")


def value_of(leaf: Leaf, rows: list[dict]) -> Any:
    """A variable's FIRST, LAST (counted from that end), COUNT, SUM, MIN, MAX or AVG of a column."""
    kind, _, column, n = leaf
    if kind in ("FIRST", "LAST"):
        return (rows[n] if kind == "FIRST" else rows[-1 - n])[column] if n < len(rows) else None
    known = [r[column] for r in rows if r[column] is not None]
    if kind == "COUNT":
        return len(known)
    if not known:
        return None
    return {"SUM": sum, "MIN": min, "MAX": max, "AVG": lambda x: float(sum(x)) / len(x)}[kind](known)


def _number(x: Any) -> Any:
    return float(x) if isinstance(x, Decimal) else x


def _haversine(a: float, b: float, c: float, d: float) -> float:
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


#: Functions of DEFINE conditions that give null where an argument is null.
FUNCTIONS: dict[str, Callable] = {"ABS": abs, "GREATEST": max, "LEAST": min, "LOWER": str.lower, "UPPER": str.upper, "HAVERSINE_KM": _haversine}
COMPARE: dict[str, Callable] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ARITHMETIC: dict[str, Callable] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else None}


class Condition:
    """A parsed DEFINE condition; call it with a function from a leaf to its value."""

    def __init__(self, sql: str):
        self.tokens = [(m[0], *m.groups()) for m in TOKEN.finditer(sql.strip())]
        if "".join(m[0] for m in self.tokens).strip() != sql.strip():
            raise ValueError(f"not understood: {sql}")
        self.at = 0
        self.leaves: set[Leaf] = set()
        self.value = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"not understood from {self.tokens[self.at][0].strip()}: {sql}")

    def __call__(self, env: Callable[[Leaf], Any]) -> bool:
        return self.value(env) is True

    def _peek(self) -> str:
        return (self.tokens[self.at][3] or self.tokens[self.at][4] or "").upper() if self.at < len(self.tokens) else ""

    def _take(self, *words: str) -> str | None:
        if self._peek() in words:
            self.at += 1
            return words[words.index((self.tokens[self.at - 1][3] or self.tokens[self.at - 1][4]).upper())]
        return None

    def _need(self, word: str) -> None:
        if not self._take(word):
            raise ValueError(f"{word} is missing")

    def _or(self) -> Value:
        value = self._and()
        while self._take("OR"):
            value = (lambda a, b: lambda e: True if (x := a(e)) is True or (y := b(e)) is True else None if x is None or y is None else False)(value, self._and())
        return value

    def _and(self) -> Value:
        value = self._not()
        while self._take("AND"):
            value = (lambda a, b: lambda e: False if (x := a(e)) is False or (y := b(e)) is False else None if x is None or y is None else True)(value, self._not())
        return value

    def _not(self) -> Value:
        if self._take("NOT"):
            own = self._not()
            return lambda e: None if (x := own(e)) is None else not x
        return self._compared()

    def _compared(self) -> Value:
        value = self._chain(self._product, "+", "-")
        if self._take("IS"):
            no = self._take("NOT")
            self._need("NULL")
            return lambda e: (value(e) is not None) if no else value(e) is None
        if op := self._take(*COMPARE):
            other = self._chain(self._product, "+", "-")
            return lambda e: None if (x := value(e)) is None or (y := other(e)) is None else bool(COMPARE[op](x, y))
        return value

    def _chain(self, part: Callable[[], Value], *signs: str) -> Value:
        value = part()
        while op := self._take(*signs):
            value = (lambda a, b, f: lambda e: None if (x := a(e)) is None or (y := b(e)) is None else f(x, y))(value, part(), ARITHMETIC[op])
        return value

    def _product(self) -> Value:
        return self._chain(self._unary, "*", "/")

    def _unary(self) -> Value:
        if self._take("-"):
            own = self._unary()
            return lambda e: None if (x := own(e)) is None else -x
        return self._primary()

    def _primary(self) -> Value:
        if self._take("("):
            value = self._or()
            self._need(")")
            return value
        if self.at >= len(self.tokens):
            raise ValueError("a condition ends too early")
        _, number, text, name, _ = self.tokens[self.at]
        self.at += 1
        if number is not None:
            return lambda e, x=float(number) if "." in number else int(number): x
        if text is not None:
            return lambda e, x=text.replace("''", "'"): x
        if name is None:
            raise ValueError(f"unexpected {self.tokens[self.at - 1][0].strip()}")
        if name.upper() in ("TRUE", "FALSE", "NULL"):
            return lambda e, x={"TRUE": True, "FALSE": False, "NULL": None}[name.upper()]: x
        if self._take("."):
            return self._leaf("LAST", name, 0)
        self._need("(")
        upper = name.upper()
        if upper in ("FIRST", "LAST", "COUNT", "SUM", "MIN", "MAX", "AVG"):
            variable = self.tokens[self.at][3]
            self.at += 1
            self._need(".")
            column = self.tokens[self.at][3]
            self.at += 1
            n = 0
            if self._take(","):
                n = int(self.tokens[self.at][1])
                self.at += 1
            self._need(")")
            return self._known((upper, variable, column, n))
        arguments = [self._or()]
        while self._take(","):
            arguments.append(self._or())
        self._need(")")
        if upper == "COALESCE":
            return lambda e: next((x for a in arguments if (x := a(e)) is not None), None)
        if upper not in FUNCTIONS:
            raise ValueError(f"function {name} is not known in a condition")
        return lambda e: None if None in (got := [a(e) for a in arguments]) else FUNCTIONS[upper](*got)

    def _leaf(self, kind: str, variable: str, n: int) -> Value:
        column = self.tokens[self.at][3]
        self.at += 1
        return self._known((kind, variable, column, n))

    def _known(self, leaf: Leaf) -> Value:
        self.leaves.add(leaf)
        return lambda e: e(leaf)


def pattern(text: str, defines: dict[str, Condition], within: float | None) -> StrictPattern:
    """A PATTERN with its conditions; a variable without one takes any row."""
    steps = []
    for m in ELEMENT.finditer(text):
        name, least, comma, most, sign, reluctant = m.groups()
        if least is not None:
            low, high = int(least), int(most) if most else None if comma else int(least)
        else:
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1), None: (1, 1)}[sign]
        condition = defines.get(name)

        def holds(row, taken, name=name, condition=condition):
            return condition is None or condition(lambda leaf: _number(value_of(leaf, [*taken.get(leaf[1], []), row] if leaf[1] == name else taken.get(leaf[1], []))))

        steps.append(Step(name, holds, low, high, bool(reluctant)))
    return StrictPattern(steps, within, "_t")


def _type(leaf: Leaf, df: DataFrame) -> DataType:
    kind, column = leaf[0], df.schema[leaf[2]].dataType
    if kind == "COUNT":
        return LongType()
    if kind == "AVG":
        return DoubleType()
    if kind == "SUM":
        return DecimalType(min(38, column.precision + 10), column.scale) if isinstance(column, DecimalType) else LongType() if isinstance(column, IntegralType) else DoubleType() if isinstance(column, FractionalType) else column
    return column


def recognize(df: DataFrame, clause: str) -> DataFrame:
    """The matches of a MATCH_RECOGNIZE clause (the text within its brackets) in df: the partition columns and MEASURES.

    A key's rows are one task's work, in order, as a match depends on their sequence; rows of a key with equal order are
    in the order of the further ORDER BY columns. Memory holds one open match. Rows without a key are a key of their own.
    """
    m = CLAUSE.fullmatch(clause.strip())
    if not m:
        raise ValueError("MATCH_RECOGNIZE needs PARTITION BY, ORDER BY, MEASURES, ONE ROW PER MATCH, AFTER MATCH SKIP PAST LAST ROW, PATTERN and DEFINE, in this order")
    keys, order, measures = [x.strip() for x in m[1].split(",")], [x.strip() for x in m[2].split(",")], split(m[3])
    within = float(int(m[5]) * SECONDS[m[6].lower().rstrip("s")]) if m[5] else None
    defines = {name: Condition(sql) for name, sql in (re.fullmatch(r"(\w+)\s+AS\s+(.*)", x, re.I | re.S).groups() for x in split(m[7]))}
    found = pattern(m[4], defines, within)
    variables = {s.name for s in found.steps}
    leaves: dict[Leaf, str] = {}

    def leaf(x: re.Match) -> str:
        own = (x[1].upper(), x[2], x[3], int(x[4] or 0)) if x[1] else ("LAST", x[5], x[6], 0)
        return leaves.setdefault(own, f"_m{len(leaves)}") if own[1] in variables else x[0]

    outputs = []
    for measure in measures:
        sql, name = re.fullmatch(r"(.*)\s+AS\s+(\w+)", measure, re.I | re.S).groups()
        outputs.append(F.expr(LEAF.sub(leaf, sql)).alias(name))
    used = {x[2] for x in leaves} | {x[2] for c in defines.values() for x in c.leaves}
    rows = df.select(*{*keys, *order, *used}, (F.unix_micros(F.col(order[0]).cast("timestamp")) / 1e6).alias("_t"))
    schema = StructType([*(df.schema[k] for k in keys), *(StructField(name, _type(x, df)) for x, name in leaves.items())])
    names = schema.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, now = None, None

        def out(matches: list[dict[str, list[dict]]]) -> list[tuple]:
            return [(*now, *(value_of(x, match.get(x[1], [])) for x in leaves)) for match in matches]

        for frame in frames:
            made = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                own = tuple(row[k] for k in keys)
                if rule is None or own != now:
                    made += out(rule.finish()) if rule else []
                    rule, now = Incremental(found), own
                made += out(rule.add(row))
            yield pd.DataFrame(made, columns=names, dtype=object)
        if rule:
            yield pd.DataFrame(out(rule.finish()), columns=names, dtype=object)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema).select(*keys, *outputs)
