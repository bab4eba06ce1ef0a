"""From a session's typed turns to one byte-budgeted, scrubbed transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import running_sum

AGENT_WORDS = ("error", "failed", "fix", "workaround", "instead", "solution")
USER_WORDS = ("error", "failed", "fix", "not working")
#: Fixed value: what a transcript over its budget ends with.
TRUNCATED = "\n[... transcript truncated ...]\n"
#: What opens each kind of turn.
PREFIXES = {"tool_result": "[TOOL_RESULT]", "assistant": "[ASSISTANT]", "assistant_turn": "[ASSISTANT]", "system": "[SYSTEM]", "user_input": "[USER]"}


def is_relevant(kind: Column, text: Column, error: Column, tool: Column = None) -> Column:
    """Tool turns, error messages, and what mentions errors or their remedies. ``tool``: the turn names a tool."""
    lower = F.lower(text)
    tool = F.lit(False) if tool is None else tool
    return (
        F.when(kind.isin("tool_call", "tool_result"), True)
        .when(kind == "system", error)
        .when(kind.isin("assistant", "assistant_turn"), X.contains_any(lower, AGENT_WORDS) | tool)
        .when(kind == "user_input", X.contains_any(lower, USER_WORDS))
        .otherwise(False)
    )


def entry(kind: Column, text: Column, tool: Column) -> Column:
    """One turn's transcript entry; null for kinds that have none."""
    prefix = F.when(kind == "tool_call", F.concat(F.lit("[TOOL_CALL: "), F.coalesce(tool, F.lit("unknown")), F.lit("]")))
    for name, value in PREFIXES.items():
        prefix = prefix.when(kind == name, value)
    cut = X.truncate_lines(text)
    return F.concat(prefix, F.when(cut == "", "").otherwise(F.concat(F.lit(" "), cut)))


def within_budget(entries: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, transcript, truncated): ``entry`` texts in ``order`` (a number), line by line, up to the first that breaks the budget.

    An entry breaks it if the bytes so far, its own and 2 exceed ``most``; later ones do not resume. Only
    entries within the budget are put together, so a transcript's task never holds more than ``most`` bytes of it.
    """
    size = F.octet_length("entry")
    rows = entries.where("entry is not null").select(key, order, "entry")
    rows = running_sum(rows, key, F.col(order), [order], (size + 1).cast("long"), "__before")
    rows = rows.withColumn("__fits", F.col("__before") + size + 2 <= most)
    breaks = rows.groupBy(key).agg(F.min(F.when(~F.col("__fits"), F.col(order))).alias("__first"))
    kept = rows.where("__fits").join(breaks, key).where(F.col("__first").isNull() | (F.col(order) < F.col("__first")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "entry"))), lambda x: F.concat(x["entry"], F.lit("\n")))
    bodies = kept.groupBy(key).agg(F.array_join(lines, "").alias("__body"))
    cut = F.col("__first").isNotNull()
    out = breaks.join(bodies, key, "left")
    return out.select(key, F.concat(F.coalesce("__body", F.lit("")), F.when(cut, TRUNCATED).otherwise("")).alias("transcript"), cut.alias("truncated"))


def transcripts(turns: DataFrame, most: int = 30_000) -> DataFrame:
    """(context_id, transcript, truncated) of typed ``turns`` (context_id, turn_id, kind, text, tool, error, names_tool)."""
    kept = turns.where(is_relevant(F.col("kind"), F.col("text"), F.col("error"), F.col("names_tool")))
    entries = kept.select("context_id", "turn_id", entry(F.col("kind"), F.col("text"), F.col("tool")).alias("entry"))
    out = within_budget(entries, "context_id", "turn_id", most)
    return out.withColumn("transcript", X.scrub(F.col("transcript"))).where(X.trim_space(F.col("transcript")) != "")


def with_project(transcript: Column, project: Column) -> Column:
    return F.when(project.isNotNull(), F.concat(F.lit("[PROJECT: "), project, F.lit("]\n\n"), transcript)).otherwise(transcript)
