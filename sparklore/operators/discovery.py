"""Which sessions a pass takes: newest first, without those already processed at the same head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(sessions: DataFrame) -> DataFrame:
    """Newest first, within their container (``place``) where sessions have one."""
    place = ["place"] if "place" in sessions.columns else []
    return sessions.orderBy(*place, F.desc("modified"), "session_id")


def unprocessed(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions with a head (not null, not 0) that ``state`` (context_id, head_turn_id) does not hold at that head."""
    alive = sessions.where(F.coalesce("head_turn_id", F.lit(0)) != 0)
    return alive.join(state.select("context_id", "head_turn_id"), ["context_id", "head_turn_id"], "left_anti")


def limit_then_filter(sessions: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` sessions, of those the unprocessed ones."""
    return unprocessed(newest_first(sessions).limit(limit), state)


def filter_then_limit(sessions: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` of the unprocessed sessions."""
    return newest_first(unprocessed(sessions, state)).limit(limit)
