"""Managed blocks in text files, as Column expressions over a table of files (path, content).

A block stands between ``<!-- sparklore:begin target=NAME -->`` and ``<!-- sparklore:end -->``. Two blocks of
a target, or one without an end, are an error, and such a file is left as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<!-- sparklore:end -->"


def begin(target: str) -> str:
    return f"<!-- sparklore:begin target={target} -->"


def wrap(target: str, content: str) -> str:
    return f"{begin(target)}\n{content}{'' if content.endswith(chr(10)) else chr(10)}{END}\n"


#: Fixed value: what the line that lists a block's topics begins with.
LISTED = "Current topics: "


def render(target: str, title: str, topics: list[str] | None = None, shell: bool = True) -> str:
    """The block that tells an agent how to use the topics; ``shell``: the agent runs commands itself."""
    steps = "Look there before running commands, with a shell:" if shell else "Ask for what is on your task before commands are run:"
    lines = [f"## {title}", "", f"Solutions to tool errors met before are kept as topics. {steps}", "", "1. `sparklore topics` lists them.", "2. `sparklore search <words>` finds those on a task.", "3. `sparklore read <topic>` shows one.", ""]
    if topics:
        lines.append(LISTED + ", ".join(topics))
    return wrap(target, "\n".join(lines))


def topic_count(content: Column) -> Column:
    """How many topics the block within ``content`` lists; 0 without such a line."""
    line = F.regexp_extract(content, rf"(?m)^{LISTED}(.*)$", 1)
    return F.when(F.coalesce(content, F.lit("")).rlike(rf"(?m)^{LISTED}"), F.size(F.split(line, ", "))).otherwise(0)


def _pattern(target: str) -> str:
    return rf"(?s)\Q{begin(target)}\E.*?\Q{END}\E\n?"


def health(content: Column, target: str) -> Column:
    """absent, healthy, duplicate or unclosed."""
    n = F.size(F.split(content, re.escape(begin(target)))) - 1
    return F.when(n == 0, "absent").when(n > 1, "duplicate").when(content.rlike(_pattern(target)), "healthy").otherwise("unclosed")


def install(content: Column, target: str, block: str) -> Column:
    """``content`` with ``block`` in place of the target's block, or after a blank line at the end."""
    ended = F.concat(content, F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n"))
    literal = block.replace("\\", "\\\\").replace("$", "\\$")
    state = health(content, target)
    return (
        F.when(content.isNull() | (content == ""), F.lit(block))
        .when(state == "absent", F.concat(ended, F.lit("\n" + block)))
        .when(state == "healthy", F.regexp_replace(content, _pattern(target), literal))
        .otherwise(content)
    )


def refresh(content: Column, target: str, block: str) -> Column:
    """Like ``install`` where there is a block already; otherwise as it was."""
    return F.when(health(content, target) == "healthy", install(content, target, block)).otherwise(content)


def remove(content: Column, target: str) -> Column:
    """``content`` without the block; blank lines collapse to one, white space at the end goes."""
    left = F.regexp_replace(F.regexp_replace(content, _pattern(target), ""), "\n{3,}", "\n\n")
    return F.when(health(content, target) == "healthy", F.regexp_replace(left, r"(?U)\s+\z", "")).otherwise(content)


def changes(files: DataFrame, target: str, block: str, action: str) -> DataFrame:
    """(path, health, action, content): what ``action`` (install, refresh or remove) does to each file; contents are not written."""
    content = F.col("content")
    made = {"install": lambda: install(content, target, block), "refresh": lambda: refresh(content, target, block), "remove": lambda: remove(content, target)}[action]()
    rows = files.select("path", health(F.coalesce("content", F.lit("")), target).alias("health"), "content", made.alias("made"))
    bad = F.col("health").isin("duplicate", "unclosed")
    done = (
        F.when(bad, "error")
        .when(F.coalesce("made", F.lit("")) == F.coalesce("content", F.lit("")), "no_change")
        .when(F.col("content").isNull(), "created")
        .when((F.lit(action) == "remove") & (F.col("made") == ""), "file_removed")
        .when(F.lit(action) == "remove", "removed")
        .when(F.col("health") == "absent", "inserted")
        .otherwise("replaced")
    )
    return rows.select("path", "health", done.alias("action"), F.col("made").alias("content"))
