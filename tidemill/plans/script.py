"""SQL scripts: variables, statements, and the run of a script as one job.

CREATE TABLE ... WITH names a source or sink: connector 'filesystem' with path and format, or 'jdbc' with url and
table-name (a sink with a PRIMARY KEY takes upserts). SELECT bodies are Spark SQL, after four rewrites:
TABLE(TUMBLE/HOP/CUMULATE(...)) becomes a window join, FOR SYSTEM_TIME AS OF an as-of join done beforehand,
MATCH_RECOGNIZE(...) the matches of a strict pattern, and INSERTs that read one view share its result.
"""

from __future__ import annotations

import logging
import os
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.expressions import register
from tidemill.operators import joins, windows
from tidemill.plans import match_sql
from tidemill.sources import jdbc, sinks

LOG = logging.getLogger(__name__)
VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")
TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"|;|[^-/'`\";]+|.", re.S)
SETTING = re.compile(r"SET\s+'([^']+)'\s*=\s*'([^']*)'", re.I | re.S)
TABLE = re.compile(r"CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*\((.*)\)\s*(?:PARTITIONED\s+BY\s*\(([^)]*)\)\s*)?WITH\s*\((.*)\)", re.I | re.S)
VIEW = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?TEMPORARY\s+VIEW\s+([\w.`]+)\s+AS\s+(.*)", re.I | re.S)
CATALOG = re.compile(r"CREATE\s+CATALOG\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+WITH\s*\((.*)\)", re.I | re.S)
DATABASE = re.compile(r"CREATE\s+DATABASE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`]+)(?:\s+WITH\s*\((.*)\))?", re.I | re.S)
INSERT = re.compile(r"INSERT\s+INTO\s+([\w.`]+)\s+(.*)", re.I | re.S)
TVF = re.compile(r"TABLE\s*\(\s*(TUMBLE|HOP|CUMULATE)\s*\(\s*TABLE\s+(\w+)\s*,\s*DESCRIPTOR\s*\(\s*(\w+)\s*\)\s*,\s*INTERVAL\s+'(\d+)'\s+(\w+)\s*(?:,\s*INTERVAL\s+'(\d+)'\s+(\w+)\s*)?\)\s*\)", re.I)
ASOF = re.compile(r"FROM\s+(\w+)\s+AS\s+(\w+)\s+LEFT\s+JOIN\s+(\w+)\s+FOR\s+SYSTEM_TIME\s+AS\s+OF\s+\2\.(\w+)\s+AS\s+(\w+)\s+ON\s+\2\.(\w+)\s*=\s*\5\.(\w+)", re.I)
PROPERTY = re.compile(r"'([^']+)'\s*=\s*'([^']*)'")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
JDBC_CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Settings of scripts that have a counterpart here.
SETTINGS = {"table.local-time-zone": "spark.sql.session.timeZone", "parallelism.default": "spark.sql.shuffle.partitions"}


def substitute(text: str, values: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; a name without value or default is an error."""
    values = os.environ if values is None else values

    def value(m: re.Match) -> str:
        if m[1] in values:
            return values[m[1]]
        if m[2] is None:
            raise ValueError(f"variable {m[1]} has no value")
        return m[2]

    return VARIABLE.sub(value, text)


def statements(text: str) -> list[str]:
    """Statements between semicolons that aren't in quotes or comments; comments go, empty statements too."""
    parts, now = [], []
    for m in TOKEN.finditer(text):
        token = m[0]
        if token == ";":
            parts.append("".join(now).strip())
            now = []
        elif not token.startswith(("--", "/*")):
            now.append(token)
        else:
            now.append(" ")
    parts.append("".join(now).strip())
    return [p for p in parts if p]


@dataclass
class Table:
    """A declared table: columns as DDL, partition columns, properties."""

    columns: str
    partitions: list[str]
    properties: dict[str, str]


@dataclass
class Script:
    """A script's state: tables, version keys, and INSERTs kept back until the end."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    inserts: list[tuple[str, str]] = field(default_factory=list)
    #: Primary keys.
    keys: dict[str, list[str]] = field(default_factory=dict)
    #: Versioned tables: key and time columns, for FOR SYSTEM_TIME AS OF.
    versions: dict[str, tuple[str, str]] = field(default_factory=dict)

    def run(self, text: str, values: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
        """Runs all statements; returns each sink's rows as written. A script without INSERT is an error."""
        register(self.spark)
        for statement in statements(substitute(text, values)):
            self.one(statement)
        if not self.inserts:
            raise ValueError("the script has no INSERT")
        return dict(self._write())

    def one(self, sql: str) -> None:
        """Runs a statement; an INSERT is kept back for the others."""
        if m := SETTING.fullmatch(sql):
            if m[1] in SETTINGS:
                self.spark.conf.set(SETTINGS[m[1]], m[2])
            else:
                LOG.warning("setting %s has no counterpart here and is passed over", m[1])
        elif m := TABLE.fullmatch(sql):
            self._table(m)
        elif m := VIEW.fullmatch(sql):
            self.query(m[2]).createOrReplaceTempView(m[1])
        elif m := CATALOG.fullmatch(sql):
            self._catalog(m[1], dict(PROPERTY.findall(m[2])))
        elif m := DATABASE.fullmatch(sql):
            place = dict(PROPERTY.findall(m[3] or "")).get("location")
            self.spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if m[1] else ''}{m[2]}" + (f" LOCATION '{place}'" if place else ""))
        elif re.match(r"EXPLAIN\b", sql, re.I):
            LOG.warning("%s", self.explain(re.sub(r"^EXPLAIN\s+", "", sql, flags=re.I)))
        elif m := INSERT.fullmatch(sql):
            self.inserts.append((m[1].strip("`"), m[2]))
        elif re.match(r"SELECT\b|WITH\b", sql, re.I):
            LOG.warning("the result of a SELECT in a script is not shown: %s", sql[:80])
            self.query(sql).write.format("noop").mode("overwrite").save()
        else:
            self.spark.sql(sql)

    def _catalog(self, name: str, properties: dict[str, str]) -> None:
        """A database's tables as a catalog of the session; other types need a catalog class of theirs ('class')."""
        kind = properties.pop("type", "")
        made = properties.pop("class", JDBC_CATALOG if kind == "jdbc" else None)
        if made is None:
            raise ValueError(f"catalog {name}: 'type' = 'jdbc', or a 'class', can be opened here")
        self.spark.conf.set(f"spark.sql.catalog.{name}", made)
        for k, v in properties.items():
            self.spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)

    def explain(self, sql: str) -> str:
        """The plan of a SELECT after the rewrites, without running it."""
        return self.query(sql)._jdf.queryExecution().executedPlan().toString()

    def _table(self, m: re.Match) -> None:
        name, body = m[1].strip("`"), m[2]
        keys = re.search(r",?\s*PRIMARY\s+KEY\s*\(([^)]*)\)\s*NOT\s+ENFORCED", body, re.I)
        mark = re.search(r",?\s*WATERMARK\s+FOR\s+(\w+)\s+AS\s+[^,]+?INTERVAL\s+'(\d+)'\s+(\w+)", body, re.I)
        for x in (keys, mark):
            body = body.replace(x[0], "") if x else body
        columns = re.sub(r"TIMESTAMP(_LTZ)?\s*\(\d+\)", "TIMESTAMP", re.sub(r"\bNOT\s+NULL\b", "", body), flags=re.I).strip().rstrip(",")
        table = Table(columns, [c.strip() for c in (m[3] or "").split(",") if c.strip()], dict(PROPERTY.findall(m[4])))
        self.tables[name] = table
        if keys and mark:
            self.versions[name] = (keys[1].strip(), mark[1])
        if keys:
            self.keys[name] = [k.strip().strip("`") for k in keys[1].split(",")]
        path = table.properties.get("path")
        if table.properties.get("connector") == "jdbc":
            if table.properties.get("mode", "source") == "source":
                jdbc.read(self.spark, table.properties["url"], table.properties["table-name"]).createOrReplaceTempView(name)
            return
        if table.properties.get("connector") != "filesystem" or not path:
            raise ValueError(f"table {name}: 'connector' = 'filesystem' with a path, or 'jdbc' with url and table-name, can be opened here")
        if table.properties.get("mode", "source") == "source":
            self.spark.read.schema(table.columns).format(table.properties.get("format", "parquet")).load(path).createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        """A SELECT after the rewrites."""
        while m := re.search(r"\bMATCH_RECOGNIZE\s*\(", sql, re.I):
            end, before = match_sql.closing(sql, m.end() - 1), sql[: m.start()].rstrip()
            if before.endswith(")"):
                start = next(i for i in range(len(before) - 1, -1, -1) if before[i] == "(" and match_sql.closing(before, i) == len(before) - 1)
                rows = self.query(before[start + 1 : -1].strip())
            else:
                start = re.search(r"[\w.`]+$", before).start()
                rows = self.spark.table(before[start:])
            match_sql.recognize(rows, sql[m.end() : end]).createOrReplaceTempView(view := f"_match_{uuid.uuid4().hex}")
            sql = f"{before[:start]} {view}{sql[end + 1 :]}"
        for n, m in enumerate(list(TVF.finditer(sql))):
            kind, name, time, size, unit, other, other_unit = m.groups()
            first, second = int(size) * SECONDS[unit.lower()], int(other or 0) * SECONDS[(other_unit or unit).lower()]
            df = self.spark.table(name)
            if kind.upper() == "TUMBLE":
                df = windows.tumble(df, time, f"{first} seconds")
            elif kind.upper() == "HOP":
                df = windows.hop(df, time, f"{second} seconds", f"{first} seconds")
            else:
                df = windows.cumulate(df, time, first, second)
            windows.bounds(df).createOrReplaceTempView(view := f"_window_{name}_{n}_{abs(hash(m[0])) % 10**8}")
            sql = sql.replace(m[0], view)
        while m := ASOF.search(sql):
            facts, alias, name, time, other, key, _ = m.groups()
            _, since = self.versions[name]
            versions = self.spark.table(name)
            take = [c for c in versions.columns if c not in (key, since)]
            prefixed = versions.select(key, since, *[versions[c].alias(f"_{other}_{c}") for c in take])
            found = joins.asof_left(self.spark.table(facts), prefixed, key, time, since, [f"_{other}_{c}" for c in take])
            found.createOrReplaceTempView(view := f"_asof_{facts}_{name}_{uuid.uuid4().hex}")
            sql = sql.replace(m[0], f"FROM {view} AS {alias}")
            sql = re.sub(rf"\b{other}\.{since}\b", f"{alias}.version_time", sql)
            sql = re.sub(rf"\b{other}\.(\w+)", rf"{alias}._{other}_\1", sql)
        return self.spark.sql(sql)

    def _append_only(self, name: str, df: DataFrame) -> DataFrame:
        """Without a key to put a change at, a sink takes no changelog; refused before a row is read."""
        return df if self.keys.get(name) else sinks.check_append_only(df)

    def _to_database(self, name: str, df: DataFrame) -> DataFrame:
        """Rows replace those of equal primary key (a key twice in one INSERT: the greatest row); without one they are
        added."""
        url, target = (self.tables[name].properties[k] for k in ("url", "table-name"))
        if keys := self.keys.get(name):
            kind = self.tables[name].properties.get("staging.string-type", "VARCHAR(4000)")
            strings = ", ".join(f"`{c}` {kind}" for c, t in df.dtypes if t == "string")
            jdbc.upsert(url, target, keys, "_order", **({"createTableColumnTypes": strings} if strings else {}))(df.withColumn("_order", F.struct(*df.columns)), 0)
        else:
            df.write.format("jdbc").options(url=url, dbtable=target).mode("append").save()
        return jdbc.read(self.spark, url, target)

    def _write(self) -> Iterator[tuple[str, DataFrame]]:
        """All INSERTs; a view that several of them read is computed once."""
        used = [set(re.findall(r"\bFROM\s+(\w+)", sql, re.I)) for _, sql in self.inserts]
        shared = {v for v in set().union(*used) if sum(v in u for u in used) > 1 and v not in self.tables}
        for v in shared:
            self.spark.table(v).persist()
        try:
            for name, sql in self.inserts:
                table = self.tables[name]
                df = self._append_only(name, self.query(sql))
                if table.properties["connector"] == "jdbc":
                    yield name, self._to_database(name, df)
                    continue
                writer = df.write.mode("append").format(table.properties.get("format", "parquet"))
                (writer.partitionBy(*table.partitions) if table.partitions else writer).save(table.properties["path"])
                yield name, self.spark.read.format(table.properties.get("format", "parquet")).load(table.properties["path"])
        finally:
            for v in shared:
                self.spark.table(v).unpersist()
