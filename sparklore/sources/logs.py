"""Session logs of coding agents in files: listings without content, turns by parsing JSON in the engine.

Every reader gives ``sessions`` (context_id, session_id, project, head_turn_id, modified, path, place) and
``read``: turns (context_id, turn_id, data VARIANT) and the sessions that could not be read (context_id, error).
``place`` orders containers of sessions before the time does. A session's version is its file size, so any
change shows as a new head. Given a few chosen sessions, only their files are opened. In place of a session's file
there may be a folder of its name (also as ``<column>=<name>``) with one part in it, as Spark's writers make them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions.turns import get_array, get_string, get_true, has
from ..operators.ordered import running_sum
from ..shared import checkpointed

V = "variant"
#: What follows a session's name in the path of a part that Spark has written.
PART = "(?:/part-[^/]*)?"
#: Listing tasks a core: a task lists many sessions' folders instead of one.
LISTING = 4
#: What opening a log counts as, in bytes read: Spark's own figure is for few large files, and has a task read some 30 logs.
OPENING = 64 * 1024


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    """What is made and run within lists folders in a bounded number of tasks, and a task reads many files.

    By default each folder is listed by a task of its own.
    """
    held = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTING * spark.sparkContext.defaultParallelism, "spark.sql.files.openCostInBytes": OPENING}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _listing(spark: SparkSession, pattern: str, suffix: str) -> DataFrame:
    """The files of ``pattern``, as they are now."""
    with _small_files(spark):
        files = spark.read.format("binaryFile").load(pattern)
        files = checkpointed(files.select("path", "length", F.unix_micros("modificationTime").alias("modified")))
    name = F.regexp_extract("path", rf"([^/]*){suffix}{PART}$", 1)
    name = F.when(F.col("path").rlike(rf"{PART[:-1]}$"), F.regexp_replace(name, "^[^=]*=", "")).otherwise(name)
    rows = files.where("length > 0").withColumn("session_id", name).where("session_id <> ''")
    return rows.withColumn("context_id", X.context_id(F.col("session_id"))).withColumn("head_turn_id", F.col("length").cast("decimal(20,0)"))


def _sessions(rows: DataFrame, project: Column) -> DataFrame:
    place = F.col("db") if "db" in rows.columns else F.lit(0)
    return rows.select("context_id", "session_id", project.alias("project"), "head_turn_id", "modified", "path", place.alias("place"))


def no_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.ERRORS)


def turn(item: str, /, **values: Column) -> Column:
    """A turn's ``data``: its type, and an object named like it that holds ``values``."""
    return F.to_variant_object(F.struct(F.lit(item).alias("item_type"), F.struct(*[v.alias(k) for k, v in values.items()]).alias(item)))


def numbered(rows: DataFrame) -> DataFrame:
    """(context_id, turn_id, data) of ``rows`` (context_id, place, data), numbered from 1 in the order of ``place``."""
    first = rows.schema["place"].dataType.names[0]
    rows = checkpointed(rows.where("data is not null"))  # files are opened and parsed once
    kept = running_sum(rows, "context_id", F.col("place")[first], ["place"], F.lit(1), "before")
    return kept.select("context_id", (F.col("before") + 1).cast("long").alias("turn_id"), "data")


def _files(spark: SparkSession, sessions: DataFrame, pattern: str, few, **options) -> DataFrame:
    """(context_id, value, split, seq): what the text reader gives of the sessions' files; ``few`` as in ``read``.

    Names with a glob's characters cannot be listed one by one; with such a one all files of ``pattern`` are read.
    """
    paths = sorted({r.path for r in few}) if few is not None else None
    if paths is None or any(c in p for p in paths for c in "*?[]{}\\"):
        paths = pattern
    elif not paths:
        return sessions.select("context_id", F.lit("").alias("value"), F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("seq")).limit(0)
    files = spark.read.text(paths, **options).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")
    key = lambda c: F.url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), "^file:/+", "/"))
    wanted = sessions.select("context_id", key(F.regexp_replace("path", "%(?![0-9A-Fa-f]{2})", "%25")).alias("__key"))
    return files.withColumn("__key", key(F.col("file"))).join(wanted, "__key").select("context_id", "value", "split", "seq")


def _lines(files: DataFrame) -> DataFrame:
    """(context_id, split, seq, entry): the lines that are JSON; others and blank ones are skipped.

    Lines are read in splits: their order in a file is that of the splits' starts, then of the rows of a split.
    """
    rows = files.withColumn("raw", X.trim_space(F.col("value"))).where("raw <> ''")
    return rows.select("context_id", "split", "seq", F.try_parse_json("raw").alias("entry")).where("entry is not null")


def _exploded(rows: DataFrame, items: Column, at: str, name: str) -> DataFrame:
    return rows.select("*", F.posexplode_outer(items).alias(at, name))


def _json_or_empty(data: Column, path: str) -> Column:
    value = F.try_variant_get(data, path, V)
    return F.coalesce(F.to_json(value), F.lit("{}"))


def _or(column: Column, default: str = "") -> Column:
    return F.coalesce(column, F.lit(default))


def _nonempty(text: Column, data: Column) -> Column:
    return F.when(_or(text) != "", data)


def claude_turns(entries: DataFrame) -> DataFrame:
    """Turns of ``entries`` (context_id, split, seq, entry): assistant, user and system records with their content blocks."""
    e, b = F.col("entry"), F.col("block")
    kind = get_string(e, "$.type")
    rows = _exploded(entries, F.when(kind.isin("assistant", "user"), get_array(e, "$.message.content")), "at", "block")
    b_type, b_text = get_string(b, "$.type"), get_string(b, "$.text")
    parts = get_array(b, "$.content")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (get_string(p, "$.type") == "text") & get_string(p, "$.text").isNotNull()), lambda p: get_string(p, "$.text")), "\n")
    result = turn("tool_result", call_id=_or(get_string(b, "$.tool_use_id")), content=F.coalesce(get_string(b, "$.content"), joined, F.lit("")), is_error=get_true(b, "$.is_error"))
    call = turn("tool_call", call_id=_or(get_string(b, "$.id")), name=_or(get_string(b, "$.name"), "unknown"), args=_json_or_empty(b, "$.input"))
    flat = F.when(has(e, "$.message"), get_string(e, "$.message.content")).otherwise(get_string(e, "$.content"))
    system = get_string(e, "$.content")
    data = (
        F.when((kind == "assistant") & (b_type == "tool_use"), call)
        .when((kind == "assistant") & (b_type == "text"), _nonempty(b_text, turn("assistant", text=b_text)))
        .when((kind == "user") & (b_type == "tool_result"), result)
        .when((kind == "user") & (b_type == "text"), _nonempty(b_text, turn("user_input", text=b_text)))
        .when((kind == "user") & b.isNull(), _nonempty(flat, turn("user_input", text=flat)))
        .when(kind == "system", _nonempty(system, turn("system", kind=_or(get_string(e, "$.subtype"), "info"), content=system)))
    )
    return numbered(rows.select("context_id", F.struct("split", "seq", "at").alias("place"), data.alias("data")))


def codex_turns(entries: DataFrame) -> DataFrame:
    """Turns of ``entries``: requested and completed calls, errors, and the texts of completed responses."""
    e = F.col("entry")
    kind, known = get_string(e, "$.type"), has(e, "$.data")
    outputs = F.when(kind == "response.completed", get_array(e, "$.data.output"))
    rows = _exploded(entries, outputs, "at", "item")
    rows = _exploded(rows, F.when(get_string(F.col("item"), "$.type") == "message", get_array(F.col("item"), "$.content")), "sub", "block")
    b_text = F.when(get_string(F.col("block"), "$.type") == "output_text", get_string(F.col("block"), "$.text"))
    data = (
        F.when((kind == "function_call_requested") & known, turn("tool_call", call_id=_or(get_string(e, "$.data.call_id")), name=_or(get_string(e, "$.data.name"), "unknown"), args=_json_or_empty(e, "$.data.arguments")))
        .when((kind == "function_call_completed") & known, turn("tool_result", call_id=_or(get_string(e, "$.data.call_id")), content=_or(get_string(e, "$.data.output")), is_error=F.lit(False)))
        .when(kind == "error", turn("system", kind=F.lit("error"), content=_or(get_string(e, "$.data.message"), "unknown error")))
        .when(kind == "response.completed", _nonempty(b_text, turn("assistant", text=b_text)))
    )
    return numbered(rows.select("context_id", F.struct("split", "seq", "at", "sub").alias("place"), data.alias("data")))


def gemini_turns(documents: DataFrame) -> DataFrame:
    """Turns of ``documents`` (context_id, entry), one JSON document a session with a list of messages."""
    rows = documents.select("context_id", F.posexplode(get_array(F.col("entry"), "$.messages")).alias("line", "m"))
    m, c, r = F.col("m"), F.col("call"), F.col("result")
    kind, said = get_string(m, "$.type"), get_string(m, "$.content")
    spoken = rows.select("context_id", F.struct("line", F.lit(-1).alias("at"), F.lit(-1).alias("sub")).alias("place"), F.when(kind == "user", _nonempty(said, turn("user_input", text=said))).when(kind == "gemini", _nonempty(said, turn("assistant", text=said))).alias("data"))
    calls = rows.where(kind == "gemini").select("context_id", "line", F.posexplode(get_array(m, "$.toolCalls")).alias("at", "call"))
    made = calls.select("context_id", F.struct("line", "at", F.lit(-1).alias("sub")).alias("place"), turn("tool_call", call_id=_or(get_string(c, "$.id")), name=_or(get_string(c, "$.name"), "unknown"), args=_json_or_empty(c, "$.args")).alias("data"))
    results = calls.select("*", F.posexplode(get_array(c, "$.result")).alias("sub", "result")).where(has(r, "$.functionResponse"))
    done = results.select("context_id", F.struct("line", "at", "sub").alias("place"), turn("tool_result", call_id=_or(get_string(c, "$.id")), content=_or(get_string(r, "$.functionResponse.response.output")), is_error=F.lit(False)).alias("data"))
    return numbered(spoken.unionByName(made).unionByName(done))


class LogReader:
    """A source of sessions. ``read(spark, sessions, few)`` gives their turns, and errors (context_id, error) of those
    without; ``few`` are collected rows of ``sessions`` where they are of a bounded number: nothing else is opened then.
    """

    #: Whether the newest sessions are taken before those already processed are left out.
    limit_first = False

    def turns(self, spark: SparkSession, sessions: DataFrame, few=None) -> DataFrame:
        return self.read(spark, sessions, few)[0]


@dataclass(frozen=True)
class ClaudeLogs(LogReader):
    """``<root>/<project>/<session>.jsonl``; the project is the folder with hyphens as slashes."""

    root: str
    limit_first = True

    def sessions(self, spark: SparkSession) -> DataFrame:
        rows = _listing(spark, f"{self.root}/*/*.jsonl", r"\.jsonl")
        return _sessions(rows, F.replace(F.regexp_extract("path", rf"([^/]+)/[^/]+\.jsonl{PART}$", 1), F.lit("-"), F.lit("/")))

    def read(self, spark: SparkSession, sessions: DataFrame, few=None) -> tuple[DataFrame, DataFrame]:
        with _small_files(spark):
            return claude_turns(_lines(_files(spark, sessions, f"{self.root}/*/*.jsonl", few, lineSep="\n"))), no_errors(spark)


@dataclass(frozen=True)
class CodexLogs(LogReader):
    """``<root>/<session>.jsonl``."""

    root: str

    def sessions(self, spark: SparkSession) -> DataFrame:
        return _sessions(_listing(spark, f"{self.root}/*.jsonl", r"\.jsonl"), F.lit(None).cast("string"))

    def read(self, spark: SparkSession, sessions: DataFrame, few=None) -> tuple[DataFrame, DataFrame]:
        with _small_files(spark):
            return codex_turns(_lines(_files(spark, sessions, f"{self.root}/*.jsonl", few, lineSep="\n"))), no_errors(spark)


@dataclass(frozen=True)
class GeminiLogs(LogReader):
    """``<root>/<project>/chats/<session>.json``, each one JSON document."""

    root: str

    def sessions(self, spark: SparkSession) -> DataFrame:
        return _sessions(_listing(spark, f"{self.root}/*/chats/*.json", r"\.json"), F.lit(None).cast("string"))

    def documents(self, spark: SparkSession, sessions: DataFrame, few=None) -> DataFrame:
        """(context_id, entry, error): a document that is no JSON has an error instead of an entry."""
        rows = _files(spark, sessions, f"{self.root}/*/chats/*.json", few, wholetext=True)
        entry = F.try_parse_json("value")
        return rows.select("context_id", entry.alias("entry"), F.when(entry.isNull(), "no JSON document").alias("error"))

    def read(self, spark: SparkSession, sessions: DataFrame, few=None) -> tuple[DataFrame, DataFrame]:
        with _small_files(spark):
            rows = checkpointed(self.documents(spark, sessions, few))
        return gemini_turns(rows.where("error is null")), rows.where("error is not null").select("context_id", "error")
