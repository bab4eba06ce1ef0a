"""Learnings into topics: creates of one slug become one, appends go into the insights section in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed
from .matching import APPEND, CREATE, NOOP
from .topics import upsert

#: Fixed value: the heading that insights go under.
SECTION = "## Key Insights"
#: What topics made by a pass have as their source.
SOURCE = "sparklore"


def union_exact(first: Column, more: Column) -> Column:
    """``first`` and what of ``more`` it lacks, in order; repeats that ``first`` has already stay."""
    return F.aggregate(more, first, lambda a, x: F.when(F.array_contains(a, x), a).otherwise(F.array_append(a, x)))


def union_caseless(first: Column, more: Column) -> Column:
    has = lambda a, x: F.exists(a, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(more, first, lambda a, x: F.when(has(a, x), a).otherwise(F.array_append(a, x)))


def _once(items: Column) -> Column:
    """``items`` without repeats, for a union that drops them one by one; with nulls, of which unions keep all, as they are."""
    return F.when(F.exists(items, lambda x: x.isNull()), items).otherwise(F.array_distinct(items))


def coalesce_creates(creates: DataFrame) -> DataFrame:
    """One learning a slug, in order of first appearance (pos): the first, with the others' summaries, evidence and tags.

    ``creates``: (pos, topic_hint, title, summary, evidence, tags, confidence, project_path).
    """
    rows = creates.withColumn("slug", X.slug(F.col("topic_hint")))
    item = F.struct("pos", "topic_hint", "title", "summary", "evidence", "tags", "confidence", "project_path")
    grouped = rows.groupBy("slug").agg(F.array_sort(F.collect_list(item)).alias("all"))
    first, rest = F.col("all")[0], F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    summary = F.concat(first["summary"], F.array_join(F.transform(rest, lambda x: F.concat(F.lit("\n\n"), x["title"], F.lit(": "), x["summary"])), ""))
    more = lambda name: _once(F.flatten(F.transform(rest, lambda x: x[name])))
    return grouped.select(
        first["pos"].alias("pos"), "slug", first["topic_hint"].alias("topic_hint"), first["title"].alias("title"), summary.alias("summary"), union_exact(first["evidence"], more("evidence")).alias("evidence"),
        union_caseless(first["tags"], more("tags")).alias("tags"), first["confidence"].alias("confidence"), first["project_path"].alias("project_path"), F.size("all").alias("merged"),
    )


def bullets(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e, F.lit("\n"))), "")


def new_body(title: Column, summary: Column, evidence: Column) -> Column:
    listed = F.when(F.size(evidence) > 0, F.concat(F.lit("## Evidence\n\n"), bullets(evidence), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), summary, F.lit("\n\n"), listed)


def insight(title: Column, summary: Column, evidence: Column, context: Column, at: Column) -> Column:
    listed = F.when(F.size(evidence) > 0, F.concat(F.lit("\n"), bullets(evidence))).otherwise("")
    # Fixed value: the line that says where an insight is from.
    when = F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")
    return F.concat(F.lit("### "), title, F.lit("\n\n"), summary, F.lit("\n"), listed, F.lit("\n_Extracted from context "), context.cast("string"), F.lit(" at "), when, F.lit("_\n"))


def _ended(text: Column) -> Column:
    return F.concat(text, F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n"))


def _around(body: Column) -> tuple[Column, Column, Column]:
    """Where the body's insights section starts (0: nowhere), the body to that section's end, and what comes behind."""
    at = F.instr(body, SECTION)
    after = F.instr(F.substr(body, at + 1), "\n## ")
    end = F.when(after > 0, at + after - 1).otherwise(F.length(body))
    return at, F.substr(body, F.lit(1), end), F.substr(body, end + 1)


def add_insight(body: Column, section: Column) -> Column:
    """``section`` at the end of the body's insights section, which is made at the body's end if missing."""
    at, head, tail = _around(body)
    return F.when(at > 0, F.concat(_ended(head), F.lit("\n"), section, tail)).otherwise(F.concat(_ended(body), F.lit(f"\n{SECTION}\n\n"), section))


def add_insights(body: Column, sections: Column) -> Column:
    """``add_insight`` of one of ``sections`` after the other, with each text looked at once instead of the growing body.

    Where a section has a heading of its own that ends the insights, the next ones go before it.
    """
    at, head, tail = _around(body)
    head = F.when(at > 0, _ended(head)).otherwise(F.concat(_ended(body), F.lit(f"\n{SECTION}\n")))
    placed = F.transform(sections, lambda s: F.concat(F.lit("\n"), s))
    cut = lambda p: F.instr(p, "\n## ")
    before = F.transform(placed, lambda p: F.when(cut(p) > 0, F.substr(p, F.lit(1), cut(p) - 1)).otherwise(p))
    behind = F.transform(placed, lambda p: F.when(cut(p) > 0, F.substr(p, cut(p))).otherwise(""))
    # All but the last are ended by the next. (What stands in a lambda is evaluated for each item: no whole array does.)
    ended = F.transform(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda p: F.when(p == "", p).otherwise(_ended(p)))
    whole = F.concat(head, F.array_join(ended, ""), F.try_element_at(before, F.lit(-1)), F.array_join(F.reverse(behind), ""), F.when(at > 0, tail).otherwise(""))
    return F.when(F.size(sections) == 0, body).when(~F.exists(sections, lambda s: s.isNull()), whole)


def merged_topics(topics: DataFrame, rows: DataFrame, context: Callable[[Column], Column], at: Column) -> DataFrame:
    """``topics`` after outcome ``rows``, see ``changed_topics``."""
    return upsert(topics, checkpointed(changed_topics(topics, rows, context, at)))


def changed_topics(topics: DataFrame, rows: DataFrame, context: Callable[[Column], Column], at: Column) -> DataFrame:
    """Those of ``topics`` that change, and new ones, after outcome ``rows`` (pos, ..., existing_slug, outcome): appends folded in order, creates coalesced.

    All appends of a topic are kept, one after the other. A created topic whose slug exists by now (as two
    sessions may both create it) replaces nothing: it is appended like any other insight. ``context`` gives
    the session's id from a row's ``pos``; the last insight's is the topic's.
    """
    keep = [f.name for f in topics.schema.fields]
    made = coalesce_creates(rows.where(F.col("outcome") == CREATE))
    clash = made.join(topics.select("slug"), "slug", "left_semi").withColumn("existing_slug", F.col("slug"))
    fresh = made.join(topics.select("slug"), "slug", "left_anti")
    columns = ["pos", "existing_slug", "title", "summary", "evidence", "tags", "project_path"]
    appends = rows.where(F.col("outcome") == APPEND).select(*columns).unionByName(clash.select(*columns))
    part = F.struct("pos", insight(F.col("title"), F.col("summary"), F.col("evidence"), context(F.col("pos")), at).alias("section"), "tags", "project_path")
    folded = appends.groupBy(F.col("existing_slug").alias("slug")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    old, parts = topics.join(folded, "slug"), F.col("parts")
    body = add_insights(F.col("body"), F.transform(parts, lambda p: p["section"]))
    tags = union_caseless(F.col("tags"), _once(F.flatten(F.transform(parts, lambda p: p["tags"]))))
    projects = union_exact(F.col("projects"), _once(F.filter(F.transform(parts, lambda p: p["project_path"]), lambda p: p.isNotNull())))
    last = context(F.element_at(parts, -1)["pos"]).cast("decimal(20,0)")
    old = old.withColumns({"body": body, "tags": tags, "projects": projects, "updated": at, "extracted_at": at, "source_context_id": last})
    none = F.array().cast("array<string>")
    new = fresh.select(
        "slug", "title", none.alias("aliases"), "tags", F.when(F.col("project_path").isNull(), none).otherwise(F.array("project_path")).alias("projects"), at.alias("created"), at.alias("updated"), at.alias("extracted_at"),
        F.lit(SOURCE).alias("source"), F.format_string("%.2f", "confidence").alias("confidence"), context(F.col("pos")).cast("decimal(20,0)").alias("source_context_id"), new_body(F.col("title"), F.col("summary"), F.col("evidence")).alias("body"),
    )
    return old.select(*keep).unionByName(new.select(*keep))


def merge_counts(rows: DataFrame) -> DataFrame:
    """(topics_created, topics_updated, duplicates_skipped) as applied: creates of one slug count once."""
    slugs = F.countDistinct(F.when(F.col("outcome") == CREATE, X.slug(F.col("topic_hint"))))
    return rows.agg(slugs.alias("topics_created"), F.count_if(F.col("outcome") == APPEND).alias("topics_updated"), F.count_if(F.col("outcome") == NOOP).alias("duplicates_skipped"))
