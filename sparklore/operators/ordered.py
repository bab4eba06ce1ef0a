"""Ordered work within a key, in blocks: no task gets all rows of a long session.

Rows of a key are cut into blocks of a bounded span of their order. What a block adds is aggregated first, a
window over blocks (few rows a key) carries it on, and a window within each block does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that a block spans.
SPAN = 4096


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until ``rows`` has no such column."""
    held = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def running_sum(rows: DataFrame, key: str, position: Column, order: list[str], value: Column, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the key's rows before. ``order`` sorts rows, and ``position`` never falls along it."""
    block, own, total, offset = fresh(rows, "block", "value", "total", "offset")
    rows = rows.withColumns({block: F.floor(position / span), own: value})
    blocks = rows.groupBy(key, block).agg(F.sum(own).alias(total))
    earlier = F.sum(total).over(Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(key, block, F.coalesce(earlier, F.lit(0)).alias(offset))
    within = F.sum(own).over(Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(offsets, [key, block]).withColumn(name, F.col(offset) + F.coalesce(within, F.lit(0))).drop(block, own, offset)


def last_before(rows: DataFrame, key: str, order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null of the key's rows before, by ``order`` (a number)."""
    block, own, last, carried = fresh(rows, "block", "value", "last", "carried")
    rows = rows.withColumns({block: F.floor(F.col(order) / span), own: value})
    blocks = rows.groupBy(key, block).agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col(order))).alias(last))
    earlier = F.last(last, True).over(Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    before = blocks.select(key, block, earlier.alias(carried))
    within = F.last(own, True).over(Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(before, [key, block]).withColumn(name, F.coalesce(within, carried)).drop(block, own, carried)
