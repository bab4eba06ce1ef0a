"""Passes over session logs: discover, reduce, extract, match, merge, mine patterns, save state.

A pass lists the sessions anew and leaves out those whose version the state table holds; the streaming query says
when to run one: at an interval, or when files have changed (``changes.py``).
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions import responses as R
from ..functions import text as X
from ..functions.turns import has, is_error, text_content, tool_name, turn_type
from ..operators import discovery, matching, merge, patterns, search, transcript
from ..shared import checkpointed
from ..sources.tables import GrowingTable, TopicTable
from .changes import changed_files
from .model import Model, answers, asked

__all__ = ["Model", "Pass", "Store", "answers", "asked", "run_once", "run_pass", "start", "typed"]

#: Sessions of a pass that are opened by name.
FEW = 1000


@dataclass
class Store:
    """Topics, and the tables of what has been processed, below one path."""

    spark: SparkSession
    path: str
    topics: TopicTable = field(init=False)
    processed: GrowingTable = field(init=False)
    extracted: GrowingTable = field(init=False)
    patterns: GrowingTable = field(init=False)

    def __post_init__(self):
        at = lambda kind, name, *more: kind(self.spark, f"{self.path}/{name}", *more)
        self.topics, self.processed = at(TopicTable, "topics", schemas.TOPICS), at(GrowingTable, "processed", schemas.PROCESSED, "context_id", "pass")
        self.extracted, self.patterns = at(GrowingTable, "extraction_hashes", schemas.HASHES), at(GrowingTable, "pattern_hashes", schemas.HASHES)

    def heads(self) -> DataFrame:
        """(context_id, head_turn_id): each session at the head that the last pass that took it has read."""
        return self.processed.read().groupBy("context_id").agg(F.max_by("head_turn_id", "pass").alias("head_turn_id"))


@dataclass(frozen=True)
class Pass:
    """What a pass did: rows with their outcome, sessions that failed (context_id, error), the sessions it took and the clusters it asked about."""

    outcomes: DataFrame
    errors: DataFrame
    sessions: DataFrame
    clusters: DataFrame | None = None

    def totals(self) -> DataFrame:
        """One row: sessions taken and failed; outcomes; clusters, the sessions in them, and what became of their directives (``from_*``)."""
        own = F.col("context_id") != 0
        slug = X.slug(F.col("topic_hint"))
        made, more, known = (F.col("outcome") == o for o in (matching.CREATE, matching.APPEND, matching.NOOP))
        out = self.outcomes.agg(
            F.countDistinct(F.when(own & made, slug)).alias("topics_created"), F.count_if(own & more).alias("topics_updated"), F.count_if(own & known).alias("duplicates_skipped"),
            F.count_if(~own).alias("directives"), F.countDistinct(F.when(~own & made, slug)).alias("from_clusters_created"), F.count_if(~own & more).alias("from_clusters_updated"), F.count_if(~own & known).alias("from_clusters_skipped"),
        )
        none = self.clusters is None
        counts = {"sessions": self.sessions.count(), "failed": self.errors.where("context_id <> 0").count(), "clusters": 0 if none else self.clusters.count(), "cluster_sessions": 0 if none else patterns.contexts(self.clusters).count()}
        return out.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "*")


def typed(turns: DataFrame) -> DataFrame:
    """``turns`` (context_id, turn_id, data) with what the operators use of ``data``."""
    d = F.col("data")
    return turns.select("context_id", "turn_id", turn_type(d).alias("kind"), text_content(d).alias("text"), tool_name(d).alias("tool"), is_error(d).alias("error"), (has(d, "$.tool") | has(d, "$.tool_use")).alias("names_tool"))


def run_once(spark: SparkSession, source, store: Store, config: Config, model: Model, synthesize: Model | None = None, at=None, dry_run: bool = False) -> DataFrame:
    """The outcome rows of ``run_pass``."""
    return run_pass(spark, source, store, config, model, synthesize, at, dry_run).outcomes


def run_pass(spark: SparkSession, source, store: Store, config: Config, model: Model, synthesize: Model | None = None, at=None, dry_run: bool = False) -> Pass:
    """One pass. With ``dry_run`` nothing is written.

    A session that cannot be read, has no answer or one that is no proper JSON is an error and is taken again;
    one whose answer was understood, or whose transcript is blank, is marked at the head that was read. Topics
    are written first, then the hashes of what they hold, and the sessions last: a pass that fails between
    is made up for by the next one.
    """
    at = F.current_timestamp() if at is None else at
    loop, known = config.loop, store.topics.read()
    pick = discovery.limit_then_filter if source.limit_first else discovery.filter_then_limit
    chosen = checkpointed(pick(source.sessions(spark), store.heads(), loop.context_limit))
    few = chosen.select("path", "session_id").limit(FEW + 1).collect()
    few = few if len(few) <= FEW else None  # many sessions are joined to, not named
    read, unread = source.read(spark, chosen, few)
    turns = checkpointed(typed(read).join(unread.select("context_id"), "context_id", "left_anti"))
    reduced = transcript.transcripts(turns, loop.max_transcript_len).join(chosen.select("context_id", "project"), "context_id")
    tags = search.tag_vocabulary(known).agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    tags = tags.first()["tags"]  # one text of the prompt, as every session is told the whole vocabulary
    system = R.system_prompt(R.EXTRACT_SYSTEM, config.dedupe.regime, F.lit(tags))
    prompts = checkpointed(reduced.select("context_id", system.alias("system"), R.extraction_prompt(F.col("context_id"), transcript.with_project(F.col("transcript"), F.col("project"))).alias("prompt")))
    responses = checkpointed(model(prompts).repartition(spark.sparkContext.defaultParallelism, "context_id"))  # few bytes, so one task would parse them all
    learned, wrong = R.parse_extractions(responses)
    silent = prompts.select("context_id").join(responses.select("context_id"), "context_id", "left_anti").withColumn("error", F.lit("no answer"))
    errors = unread.unionByName(wrong).unionByName(silent).groupBy("context_id").agg(F.min("error").alias("error"))
    learned = learned.where(F.col("confidence") >= loop.confidence_threshold).drop("project_path").join(chosen.select("context_id", F.col("project").alias("project_path")), "context_id")
    learned = learned.withColumn("hash", X.content_hash(F.col("topic_hint"), F.col("title"), F.col("summary")))
    learned = checkpointed(learned)
    rows = learned.join(store.extracted.read(learned), "hash", "left_anti").withColumn("pos", F.struct("context_id", "n"))
    found = None
    if loop.patterns.enabled and synthesize is not None:
        found = _clusters(turns, chosen, store, config)
        directives, failed = _directives(found, synthesize, spark)
        rows, errors = rows.unionByName(directives.select(*rows.columns)), errors.unionByName(failed)
    errors = checkpointed(errors)
    rows = rows.withColumn("learning_id", F.concat_ws("-", F.col("pos.context_id").cast("string"), F.col("pos.n").cast("string")))
    result = checkpointed(matching.outcomes(rows, known, config.dedupe))
    if not dry_run:
        store.topics.apply(merge.changed_topics(known, result, lambda pos: pos["context_id"], at))
        store.extracted.append(result.where(F.col("context_id") != 0).select("hash").distinct())
        if found is not None and errors.where("context_id = 0").isEmpty():
            store.patterns.append(found.select(F.col("content_hash").alias("hash")))
        done = chosen.select("context_id", "head_turn_id").join(errors.select("context_id"), "context_id", "left_anti")
        store.processed.append(done.withColumn("pass", F.lit(time.time_ns() // 1000)))
    return Pass(result, errors, chosen, found)


def _clusters(turns: DataFrame, chosen: DataFrame, store: Store, config: Config) -> DataFrame:
    """The pass's repeated messages that no earlier pass has asked about."""
    numbered = lambda rows: rows.withColumn("idx", F.struct("context_id", "turn_id")).join(chosen.select("context_id", "project"), "context_id")
    known = store.patterns.read().select(F.col("hash").alias("content_hash"))
    return checkpointed(patterns.detect(numbered(patterns.user_messages(turns)), numbered(patterns.corrections(turns)), config.loop.patterns, known))


def _directives(found: DataFrame, synthesize: Model, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(learnings, errors), both of context 0, from what the model makes of the clusters."""
    none = spark.createDataFrame([], schemas.RESPONSES)
    silent = spark.createDataFrame([], schemas.ERRORS)
    responses = none
    if not found.isEmpty():
        ordered = found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "kind", "leader")))  # max_clusters_per_pass rows at most
        prompt = R.synthesis_prompt(ordered).select(F.lit(0).cast("decimal(20,0)").alias("context_id"), R.system_prompt(R.SYNTHESIZE_SYSTEM).alias("system"), "prompt")
        responses = checkpointed(synthesize(prompt))
        if responses.isEmpty():
            silent = spark.createDataFrame([(0, "no answer")], "id int, error string").select(F.col("id").cast("decimal(20,0)").alias("context_id"), "error")
    learned, wrong = R.parse_directives(responses)
    learned = learned.withColumn("hash", X.content_hash(F.col("topic_hint"), F.col("title"), F.col("summary")))
    return learned.withColumn("pos", F.struct("context_id", "n")), wrong.unionByName(silent)


def start(spark: SparkSession, run_pass: Callable[[], object], checkpoint: str, seconds: int | None = None, failures: int = 5, watch: list[str] | None = None, quiet: float = 10, most: float = 900):
    """A streaming query that calls ``run_pass`` at once and then every ``seconds``; None: a single time.

    With ``watch`` (folders or files) it is called when something there has changed and has been ``quiet`` for a while, or
    for ``most`` seconds at the latest, and then looks every second or so (``seconds``). A failing pass is made up for at
    the next trigger. The query fails with it where that is the only one, or the last of ``failures`` in a row.
    """
    if watch:
        ticks = changed_files(spark, watch, f"{checkpoint}-snapshots", quiet=0 if seconds is None else quiet, most=most, idle=most)
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    failed = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal failed
        if watch and not failed and batch.isEmpty():
            return
        try:
            run_pass()
            failed = 0
        except Exception as e:
            failed += 1
            if seconds is None or failed >= failures:
                raise
            print(f"pass {number} failed, {failed} in a row: {e}", file=sys.stderr)

    writer = ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
