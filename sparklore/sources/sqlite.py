"""Session logs in SQLite files, read by a Python data source, read-only: partitions are ranges of a database's rows.

Filters on a column, also of many values, are pushed to SQLite, and only the columns of the schema are selected.
"""

from __future__ import annotations

import json
import sqlite3
from dataclasses import dataclass
from glob import glob
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

from ..functions import text as X
from ..functions.turns import get_string, has
from ..shared import checkpointed
from .logs import LogReader, _exploded, _json_or_empty, _nonempty, _or, _sessions, no_errors, numbered, turn

ROWS = 4096
#: Rows (by their numbers) that one partition reads.
RANGE = 200_000
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f) -> tuple[str, list] | None:
    """A pushed filter in SQLite's words, and the values for its ?; None if it stays with Spark."""
    if isinstance(f, Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] in ("db", "error"):
        return None
    name = '"' + f.attribute[0].replace('"', '""') + '"'
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    if isinstance(f, In) and all(isinstance(v, int | str) for v in f.value):
        return f"{name} IN (SELECT value FROM json_each(?))", [json.dumps(list(f.value))]
    if type(f) in COMPARED and isinstance(f.value, int | str | float):
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    return None


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.paths = schema, json.loads(options["paths"])
        table = options["table"]
        self.rows = table if table.startswith("SELECT ") else f'SELECT *, rowid AS "row" FROM "{table}"'
        self.wheres, self.given, self.chosen, self.only = [], [], False, None

    def pushFilters(self, filters):
        """Take what SQLite can tell; a filter on ``db`` leaves databases unopened."""
        for f in filters:
            known = condition(f)
            if known:
                self.wheres.append(known[0])
                self.given += known[1]
                self.chosen |= isinstance(f, EqualTo | In)
            elif isinstance(f, EqualTo | In) and f.attribute == ("db",):
                self.only = {f.value} if isinstance(f, EqualTo) else set(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("db",)):
                yield f

    def partitions(self):
        """A database whose row numbers cannot be asked for is one partition, which then says what is wrong with it."""
        found = []
        for n, path in enumerate(self.paths):
            if self.only is not None and n not in self.only:
                continue
            low = high = None
            if not self.chosen:
                try:
                    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                        low, high = db.execute(f'SELECT min("row"), max("row") FROM ({self.rows})').fetchone()
                except sqlite3.Error:
                    pass
            cuts = range(low, high + 1, RANGE) if low is not None else (None,)
            found += [InputPartition((n, path, cut)) for cut in cuts]
        return found

    def read(self, partition):
        """The rows, then one of nulls and an error if reading has failed, so that no half is taken for all."""
        from pyspark.sql.pandas.types import to_arrow_schema

        n, path, cut = partition.value
        schema = to_arrow_schema(self.schema)
        fields = list(schema)[1:-1]
        wheres, given = list(self.wheres), list(self.given)
        if cut is not None:
            wheres.append('"row" BETWEEN ? AND ?')
            given += [cut, cut + RANGE - 1]
        columns = ", ".join(f'"{f.name}"' for f in fields)
        statement = f"SELECT {columns} FROM ({self.rows})" + (" WHERE " + " AND ".join(f"({w})" for w in wheres) if wheres else "")
        try:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                cursor = db.execute(statement, given)
                while rows := cursor.fetchmany(ROWS):
                    values = [pa.array([_as(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows), fields)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), *values, pa.nulls(len(rows), pa.string())], schema=schema)
        except sqlite3.Error as e:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.nulls(1, f.type) for f in fields], pa.array([f"{path}: {e}"])], schema=schema)


def _as(value, kind):
    """``value`` as the column's type; SQLite types values, not columns."""
    if value is None:
        return None
    try:
        return int(value) if pa.types.is_integer(kind) else str(value)
    except ValueError:
        return None


class SqliteSource(DataSource):
    """Options: ``paths`` (a JSON list) and ``table``, a table's name or a SELECT with a column ``row`` to part it by.

    The schema's first column is the database's number, its last the error of one that could not be read. Such a row
    has nulls besides; a filter that SQLite takes does not drop it.
    """

    @classmethod
    def name(cls):
        return "sqlite_logs"

    def schema(self):
        raise ValueError("give a schema")

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def query(spark: SparkSession, paths, table: str, schema: str) -> DataFrame:
    """(db, ..., error): the columns of ``schema`` (``row`` is the row's number) of ``table`` in every database of ``paths``."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_logs").schema(f"db int, {schema}, error string").options(paths=json.dumps(list(paths)), table=table).load()


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context_id", X.context_id(F.col("session_id")))


@dataclass(frozen=True)
class SqliteLogs(LogReader):
    """Databases in the order in which their sessions are taken; those that cannot be listed have no sessions."""

    paths: tuple[str, ...]

    def _placed(self, rows: DataFrame) -> DataFrame:
        return _keyed(rows.where("error is null")).withColumn("path", F.element_at(F.array(*map(F.lit, self.paths)), F.col("db") + 1))

    def _asked(self, rows: DataFrame, few) -> DataFrame:
        """``rows`` of the sessions ``few`` (of all if None), and of no other database."""
        if few is None:
            return rows
        used = {r.path for r in few}
        return rows.where(F.col("db").isin([n for n, p in enumerate(self.paths) if p in used]) & F.col("session_id").isin(sorted({r.session_id for r in few})))

    def _failed(self, spark: SparkSession, sessions: DataFrame, *tables: DataFrame) -> DataFrame:
        """(context_id, error) of the sessions in databases that some read has failed on."""
        failed = tables[0].where("error is not null").select("db", "error")
        for t in tables[1:]:
            failed = failed.unionByName(t.where("error is not null").select("db", "error"))
        failed = failed.groupBy("db").agg(F.min("error").alias("error"))
        return sessions.select("context_id", F.col("place").alias("db")).join(failed, "db").select("context_id", "error")


@dataclass(frozen=True)
class CrushLogs(SqliteLogs):
    """``crush.db`` files: sessions with messages, each message a list of parts."""

    @classmethod
    def of_manifest(cls, path: str) -> CrushLogs:
        """The databases of ``projects.json`` that exist, in its order."""
        try:
            projects = json.loads(Path(path).expanduser().read_text()).get("projects") or []
        except FileNotFoundError:
            projects = []
        found = [Path(p["data_dir"]) / "crush.db" for p in projects if p.get("data_dir")]
        return cls(tuple(str(p) for p in found if p.exists()))

    def sessions(self, spark: SparkSession) -> DataFrame:
        rows = query(spark, self.paths, "sessions", "id string, title string, message_count long, updated_at long").where("message_count > 0")
        rows = self._placed(rows.withColumnRenamed("id", "session_id")).withColumn("head_turn_id", F.col("message_count").cast("decimal(20,0)")).withColumn("modified", F.col("updated_at"))
        return _sessions(rows, F.col("title"))

    def read(self, spark: SparkSession, sessions: DataFrame, few=None) -> tuple[DataFrame, DataFrame]:
        rows = checkpointed(self._asked(query(spark, self.paths, "messages", "session_id string, role string, parts string, created_at long, row long"), few))
        errors = self._failed(spark, sessions, rows)
        wanted = sessions.select("context_id", F.col("place").alias("db")).join(errors, "context_id", "left_anti")
        return crush_turns(_keyed(rows.where("error is null")).join(wanted, ["context_id", "db"], "left_semi")), errors


def crush_turns(messages: DataFrame) -> DataFrame:
    """Turns of ``messages`` (context_id, role, parts, created_at, row)."""
    parts = F.try_variant_get(F.try_parse_json("parts"), "$", "array<variant>")
    rows = _exploded(messages, parts, "at", "part")
    p, role = F.col("part"), F.col("role")
    kind, said, content = get_string(p, "$.type"), get_string(p, "$.data.text"), _or(get_string(p, "$.data.content"))
    failed = F.contains(content, F.lit("ERROR")) | F.contains(content, F.lit("Exit code 1")) | F.contains(content, F.lit("error:"))
    data = (
        F.when((role == "user") & (kind == "text"), _nonempty(said, turn("user_input", text=said)))
        .when((role == "assistant") & (kind == "text"), _nonempty(said, turn("assistant", text=said)))
        .when((role == "assistant") & (kind == "tool_call"), turn("tool_call", call_id=_or(get_string(p, "$.data.id")), name=_or(get_string(p, "$.data.name"), "unknown"), args=_or(get_string(p, "$.data.input"), "{}")))
        .when((role == "tool") & (kind == "tool_result"), turn("tool_result", call_id=_or(get_string(p, "$.data.tool_call_id")), content=content, is_error=failed))
    )
    return numbered(rows.select("context_id", F.struct("created_at", "row", "at").alias("place"), data.alias("data")))


@dataclass(frozen=True)
class OpenCodeLogs(SqliteLogs):
    """``opencode.db`` files: sessions that are not archived, messages, and the parts of each message."""

    @classmethod
    def found(cls, config: str, projects: str = "~/Documents") -> OpenCodeLogs:
        """The database of the ``config`` folder, then those of the folders below ``projects``, where they exist."""
        own = Path(config).expanduser() / "opencode.db"
        return cls((*([str(own)] if own.exists() else []), *sorted(glob(str(Path(projects).expanduser() / "*" / ".opencode" / "opencode.db")))))

    def sessions(self, spark: SparkSession) -> DataFrame:
        rows = query(spark, self.paths, "session", "id string, directory string, time_updated long, time_archived long").where("time_archived is null and time_updated <> 0")
        rows = self._placed(rows.withColumnRenamed("id", "session_id")).withColumn("head_turn_id", F.col("time_updated").cast("decimal(20,0)")).withColumn("modified", F.col("time_updated"))
        return _sessions(rows, F.col("directory"))

    def read(self, spark: SparkSession, sessions: DataFrame, few=None) -> tuple[DataFrame, DataFrame]:
        messages = checkpointed(self._asked(query(spark, self.paths, "message", "id string, session_id string, data string, time_created long, row long"), few))
        # Of few sessions SQLite looks up the parts by its own indexes; of all, parts are read in ranges and joined here.
        owned = "SELECT part.message_id AS id, message.session_id AS session_id, part.data AS data, part.time_created AS time_created, part.rowid AS row FROM part JOIN message ON message.id = part.message_id"
        alone = "SELECT message_id AS id, data, time_created, rowid AS row FROM part"
        parts = query(spark, self.paths, alone if few is None else owned, "id string, data string, time_created long, row long" if few is None else "id string, session_id string, data string, time_created long, row long")
        parts = checkpointed(self._asked(parts, few).select("db", "id", F.col("data").alias("part"), F.col("time_created").alias("part_created"), F.col("row").alias("part_row"), "error"))
        errors = self._failed(spark, sessions, messages, parts)
        wanted = sessions.select("context_id", F.col("place").alias("db")).join(errors, "context_id", "left_anti")
        rows = _keyed(messages.where("error is null").drop("error")).join(wanted, ["context_id", "db"], "left_semi")
        return opencode_turns(rows.join(parts.where("error is null").drop("error"), ["db", "id"])), errors


def opencode_turns(rows: DataFrame) -> DataFrame:
    """Turns of ``rows`` (context_id, data, time_created, row, part, part_created, part_row), messages joined to their parts."""
    m, p = F.try_parse_json("data"), F.try_parse_json("part")
    role, kind = get_string(m, "$.role"), get_string(p, "$.type")
    said = F.when(has(p, "$.text"), get_string(p, "$.text")).otherwise(get_string(p, "$.content"))
    status = get_string(p, "$.state.status")
    result = F.when(status == "error", get_string(p, "$.state.error")).otherwise(get_string(p, "$.state.output"))
    call_id = _or(get_string(p, "$.callID"))
    spoken = F.when(role == "user", turn("user_input", text=said)).otherwise(turn("assistant", text=said))
    call = turn("tool_call", call_id=call_id, name=_or(get_string(p, "$.tool"), "unknown"), args=_json_or_empty(p, "$.state.input"))
    done = F.when(status.isin("completed", "error"), turn("tool_result", call_id=call_id, content=_or(result), is_error=status == "error"))
    both = F.when(kind == "text", F.array(_nonempty(said, spoken))).when(kind == "tool", F.array(call, done))
    rows = _exploded(rows.where(m.isNotNull() & p.isNotNull()), both, "at", "turn")
    return numbered(rows.select("context_id", F.struct("time_created", "row", "part_created", "part_row", "at").alias("place"), F.col("turn").alias("data")))
