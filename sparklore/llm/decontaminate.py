"""Operator 1: benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits keeps one of k + 1 pieces intact. All pieces are
found exactly in one pass (Aho-Corasick); from a hit the match grows by halves: a group of j pieces must
match with at most j - 1 edits, checked by Myers' bit-parallel distance, up to the whole item with k.
Test items go to the tasks in blocks of bounded size; documents stay where they are and are never shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_state

#: Edits allowed for each character of a test item (after folding), rounded down.
ERROR_RATE = 0.08
#: Bytes of test items that tasks get at a time.
BLOCK_BYTES = 8 << 20
#: Windows a worker remembers verdicts of; at the bound it starts anew.
REMEMBERED = 50_000

_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower-case words of letters and digits, parted by single spaces: what is compared."""
    return _APART.sub(" ", text or "").strip().lower()


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` within ``most`` edits, the first of equals."""
    m = len(pattern)
    mask, top, equal = (1 << m) - 1, 1 << m - 1, {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, None
    for at, c in enumerate(text):
        eq = equal.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (mask & ~(h | plus)), plus & h
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | (mask & ~(v | up)), up & v
        if score <= most:
            best, most = (score, at + 1), score - 1
            if not score:
                break
    return best


class Item:
    """A folded test item, its k + 1 pieces, and for each piece the groups it grows through."""

    def __init__(self, item_id, text: str, rate: float):
        self.id, self.text, self.k = item_id, text, int(len(text) * rate)
        n, p = len(text), self.k + 1
        self.cuts = [n * i // p for i in range(p + 1)]
        self.pieces = [text[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        self.grows: list[list[tuple[int, int]]] = [[] for _ in range(p)]
        self._split(0, p)

    def _split(self, lo: int, hi: int) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            self._split(lo, mid)
            self._split(mid, hi)
            for i in range(lo, hi):
                self.grows[i].append((lo, hi))


class Matcher:
    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.automaton, pieces = ahocorasick.Automaton(), {}
        self.items = [Item(i, t, rate) for i, text in items if (t := fold(text))]
        for at, item in enumerate(self.items):
            for k, piece in enumerate(item.pieces):
                pieces.setdefault(piece, []).append((at, k))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()
        self.verdicts: dict = {}

    def _grown(self, item: Item, k: int, text: str, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) in ``text`` of the match around piece ``k`` of ``item`` at ``at``."""
        origin = at - item.cuts[k]
        if text.startswith(item.text, max(origin, 0)) and origin >= 0:
            return 0, origin, origin + len(item.text)
        if item.k == 0:
            return None
        for lo, hi in item.grows[k]:
            slack, a, b = hi - lo - 1, item.cuts[lo], item.cuts[hi]
            begin = max(0, origin + a - slack)
            window = text[begin : origin + b + slack]
            key = (item.id, lo, hi, window)
            if key not in self.verdicts:
                if len(self.verdicts) > REMEMBERED:
                    self.verdicts.clear()
                self.verdicts[key] = myers(item.text[a:b], window, slack)
            found = self.verdicts[key]
            if found is None:
                return None
        distance, end = found
        back = myers(item.text[::-1], window[:end][::-1], distance)
        return distance, begin + end - back[1], begin + end

    def matches(self, text: str) -> list[tuple]:
        """(item id, distance, start, end): the best match of each item in folded ``text``, the first of equals."""
        if not self.items:
            return []
        best: dict[int, tuple] = {}
        tried: set = set()
        for last, (size, owners) in self.automaton.iter(text):
            at = last + 1 - size
            for which, k in owners:
                item = self.items[which]
                known = best.get(which)
                if known and (known[0] == 0 or known[1] <= at < known[2]):
                    continue
                place = (which, k, at)
                if place not in tried:
                    tried.add(place)
                    found = self._grown(item, k, text, at)
                    if found and (known is None or found < known):
                        best[which] = found
        return [(self.items[w].id, *f) for w, f in best.items()]


def _matcher(items, rate: float) -> Matcher:
    return worker_state(("items", items.id, rate), lambda: Matcher(items.value, rate))


class _Shipped:
    """A broadcast with an id that workers know their matcher by."""

    def __init__(self, spark, items):
        self.shared = spark.sparkContext.broadcast(items)
        self.id = self.shared._jbroadcast.id()

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int = BLOCK_BYTES):
    """The test items as lists of about ``most_bytes`` at most. Items without letters or digits match nothing."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // most_bytes)
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(doc id, item_id, distance, start, end): each test item's best match in each document's whole text.

    Both are folded first (``fold``); ``start`` and ``end`` count characters of the folded text.
    ``distance`` is at most ``rate`` times the item's folded length. Null and empty texts, and items
    without letters or digits, match nothing. Rows that repeat a document are matched each; items that
    repeat are one. Columns besides those named are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_kind}, item_id {item_kind}, distance int, start int, end int"
    parts = []
    for items in blocks(benchmark, item_col, item_text_col):
        shipped = _Shipped(spark, items)

        def run(batches, shipped=shipped):
            matcher = _matcher(shipped, rate)
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for m in matcher.matches(fold(t))]
                columns = list(zip(*found)) or [[]] * 5
                kinds = [batch.schema.field(0).type, {"string": pa.string(), "int": pa.int32()}.get(item_kind, pa.int64()), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, "item_id", "distance", "start", "end"])

        parts.append(docs.select(id_col, text_col).mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows whose text holds a test item (see ``contaminated``); null texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for items in blocks(benchmark, item_col, item_text_col):
        shipped = _Shipped(spark, items)

        def run(batches, shipped=shipped):
            matcher = _matcher(shipped, rate)
            for batch in batches:
                clean = [not (t and matcher.matches(fold(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
