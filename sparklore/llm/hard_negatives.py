"""Operator 13: hard negatives by Four-Russians scoring.

Components are whole numbers. Candidates are packed into tiles of bit planes: for each plane of the two's complement
and each group of eight dimensions one byte a row. An anchor has, for each group, a table of the sums of all 256 subsets
of its eight components; a candidate's byte is the index. Plane by plane, twice what there is plus the looked-up sums
(less, for the sign's plane) give the whole inner product, exactly and without a multiplication of components.

Tiles hold rows that follow each other by (label, id), whatever share of the table a label has, and blocks hold
anchors likewise. Positives come from the tiles that share a label with a block, negatives from all tiles. A tile is
dealt to a slot of every block, so that no task has all tiles of a block; a task keeps the best of what it has seen
and sends on no more than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Rows of a tile, anchors of a block, and how many of these are looked up at a time (their tables should stay in cache).
TILE, BLOCK, AT_ONCE = 1024, 2048, 256
#: Blocks of a task whose tables are kept (some 16 MB each).
TABLES = 4


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, rows, groups) bytes of the two's complement of whole ``x`` (rows, dims), the sign's plane last."""
    n = max(int(x.max(initial=0)).bit_length(), int(~x.min(initial=0)).bit_length()) + 1
    return np.stack([np.packbits((x >> k & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(n)])


def subset_sums(a: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions of ``a`` (anchors, dims) the sums of all subsets of its components."""
    padded = np.pad(a, ((0, 0), (0, -a.shape[1] % 8)))
    out = np.zeros((padded.shape[1] // 8, 256, len(a)), a.dtype)
    for g in range(len(out)):
        for i in range(8):
            np.add(out[g, : 1 << i], padded[:, 8 * g + i], out=out[g, 1 << i : 2 << i])
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products; groups that only one side has count as zeros."""
    out = np.zeros((planes.shape[1], sums.shape[2]), sums.dtype)
    found = np.empty_like(out)
    for k in range(len(planes) - 1, -1, -1):
        out += out
        for g in range(min(planes.shape[2], len(sums))):
            np.take(sums[g], planes[k, :, g], axis=0, out=found, mode="clip")
            (np.subtract if k == len(planes) - 1 else np.add)(out, found, out=out)
    return out


class Best:
    """The ``most`` best (score, then smallest id) of each of ``n`` lists, from candidates as they come."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.at, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, ids: np.ndarray, scores_: np.ndarray) -> None:
        """Candidates: the list, id and score of each. Those under a full list's ``least`` need not be given."""
        at, ids, scores_ = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores_.astype(np.int64)])
        order = np.lexsort((ids, -scores_, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.most
        self.at, self.ids, self.scores = at[kept], ids[order][kept], scores_[order][kept]
        full = rank == self.most - 1
        self.least[at[full]] = scores_[order][full]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double; null for a null vector or one with a null or non-finite component."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    too_large = F.raise_error("a component is too large for whole numbers").cast("long")
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**62, F.floor(v * scale)).otherwise(too_large)))


def _matrix(lists: pa.Array) -> np.ndarray:
    """The lists as rows of a matrix, shorter ones with zeros at their end."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def _packed(rows: DataFrame, size: int, planes: bool) -> DataFrame:
    """``rows`` (id, label, v) in groups of ``size`` that follow each other by (label, id): ids, labels, the numbers, the largest sum of a row's."""
    ranged = rows.select("id", "label", "v").repartitionByRange("label", "id").sortWithinPartitions("label", "id")

    def packed(part: pa.Table) -> pa.RecordBatch:
        x, labels = _matrix(part.column("v").combine_chunks()), part.column("label").combine_chunks()
        data = bit_planes(x) if planes else x
        columns = [pa.array([np.asarray(part.column("id"))]), pa.ListArray.from_arrays([0, len(labels)], labels), pa.array([data.tobytes()]), pa.array([list(data.shape)]), pa.array([np.abs(x.astype(float)).sum(axis=1).max(initial=0.0)])]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "data", "shape", "norm"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                together = pa.Table.from_batches(held)
                yield packed(together.slice(0, size))
                held, n = together.slice(size).to_batches(), n - size
        if n:
            yield packed(pa.Table.from_batches(held))

    label = rows.schema["label"].dataType.simpleString()
    out = ranged.mapInArrow(run, f"ids array<long>, labels array<{label}>, data binary, shape array<long>, norm double")
    return out.select(F.monotonically_increasing_id().alias("number"), "*")


def _dealt(pairs: DataFrame, blocks: DataFrame, n_rows: int, n_blocks: int) -> DataFrame:
    """``pairs`` (a tile's columns, block) with their block's columns (``a_``), those of a block and slot in one task, in any order.

    Blocks are copied to as many slots as keep all tasks at work: to many where blocks are few, to one where they are many,
    but each for the rows of two full tiles at least.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(-(-n_rows // (2 * TILE)), -(-2 * tasks // max(1, n_blocks))))
    left = pairs.withColumn("slot", F.pmod(F.xxhash64("number"), F.lit(slots)).cast("int")).repartition(tasks, "block", "slot")
    right = blocks.select(F.col("number").alias("block"), *(F.col(c).alias(f"a_{c}") for c in blocks.columns if c != "number"))
    right = right.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(tasks, "block", "slot")
    return left.join(right.hint("shuffle_hash"), ["block", "slot"])


def _array(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column(name).flatten().to_numpy(zero_copy_only=False)


def _numbers(row: pa.RecordBatch, prefix: str, kind: type) -> np.ndarray:
    return np.frombuffer(row.column(f"{prefix}data")[0].as_buffer(), kind).reshape(row.column(f"{prefix}shape")[0].as_py())


class _Block:
    """The anchors of a block, their tables, and ``lists`` lists of each anchor's best candidates so far."""

    def __init__(self, row: pa.RecordBatch, lists: int, most: int):
        self.row, self.anchors = row, _numbers(row, "a_", np.int64)
        self.ids, self.labels, self.kind = _array(row, "a_ids"), _array(row, "a_labels"), None
        self.parts = [slice(at, at + AT_ONCE) for at in range(0, len(self.anchors), AT_ONCE)]
        self.best = [Best(len(self.ids[a]) * lists, most) for a in self.parts]

    def forget(self) -> None:
        """Let the tables go; they are made again when a tile comes."""
        self.kind, self.sums = None, []

    def tables(self, norm: float) -> None:
        """Have tables of a type that holds the products of rows of that norm."""
        bound = 1.01 * norm * float(np.abs(self.anchors).max(initial=0))
        if bound >= 2.0**63:
            raise OverflowError("inner products of these components may not fit a long")
        kind = np.int32 if bound < 2.0**31 else np.int64
        if self.kind is None or kind is np.int64 is not self.kind:
            self.kind = kind
            self.sums = [subset_sums(self.anchors[a].astype(kind)) for a in self.parts]

    def scored(self, row: pa.RecordBatch):
        """(anchors' slice, lists, rows' slice, scores) of the tile; few rows at a time while the lists are empty."""
        self.tables(row.column("norm")[0].as_py())
        planes = _numbers(row, "", np.uint8)
        for a, best, sums in zip(self.parts, self.best, self.sums):
            at, step = 0, 32 if not len(best.at) else 512
            while at < planes.shape[1]:
                yield a, best, slice(at, at + step), scores(planes[:, at : at + step], sums)
                at, step = at + step, min(step * 2, 512)


def _best_of(batches, lists: int, most: int, fitting, told):
    """``told`` of every block after all its tiles of this task; ``fitting`` gives the lists, rows and anchors of the scores that count.

    Tiles of a task's blocks (a few) come in any order; blocks keep their lists, and the last few their tables.
    """
    blocks: dict[int, _Block] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            number = row.column("block")[0].as_py()
            block = blocks.pop(number, None) or _Block(row, lists, most)
            blocks[number] = block
            if len(blocks) > TABLES:
                list(blocks.values())[-TABLES - 1].forget()
            ids, labels = _array(row, "ids"), _array(row, "labels")
            for a, best, r, s in block.scored(row):
                at, i, j = fitting(block, a, best.least, ids[r], labels[r], s)
                if len(at):
                    best.add(at, ids[r][i], s[i, j])
    yield from map(told, blocks.values())


def _found(block: _Block, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, its list, id, score) of all that the block's lists hold."""
    at = np.concatenate([best.at + a.start * lists for a, best in zip(block.parts, block.best)])
    return at // lists, at % lists, np.concatenate([best.ids for best in block.best]), np.concatenate([best.scores for best in block.best])


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives of an anchor are its first ``positives`` other rows of its label, by inner product of whole components
    (``whole_numbers``), then by id. For each, the first ``negatives`` rows of other labels whose score is from ``low``
    to ``high`` hundredths of the positive's; a positive of a score under zero has none, one of zero those of zero.
    Rows with a null id or label, a null vector or a null or non-finite component take no part. Of rows that repeat
    an id, that of the smallest (label, components) counts. Shorter vectors count as with zeros at their end.
    Scores that may not fit a long are an error. ``is_anchor`` is a condition on columns of ``vectors``; ids are whole
    numbers; other columns are ignored; empty in, empty out.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    rows = stored(rows, "negatives_rows")
    tiles, blocks = stored(_packed(rows, tile, True), "negatives_tiles"), stored(_packed(rows.where("anchor"), block, False), "negatives_blocks")
    n_rows, numbers = rows.count(), [r.number for r in blocks.select("number").collect()]  # one of some 200,000 rows
    has = lambda df, name: df.select(F.col("number").alias(name), F.explode(F.array_distinct("labels")).alias("label"))
    same = has(tiles, "number").join(has(blocks, "block"), "label").select("number", "block").distinct()

    def same_label(block_, a, least, ids, labels, s):
        i, j = np.nonzero((s >= least) & (labels[:, None] == block_.labels[a]) & (ids[:, None] != block_.ids[a]))
        return j, i, j

    def positives_of(block_):
        anchor, _, ids, found = _found(block_, 1)
        return pa.RecordBatch.from_arrays([pa.array(block_.ids[anchor]), pa.array(ids), pa.array(found)], names=["anchor_id", "positive_id", "positive_score"])

    near = _dealt(same.join(tiles, "number"), blocks, n_rows, len(numbers)).mapInArrow(lambda b: _best_of(b, 1, positives, same_label, positives_of), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = stored(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives), "negatives_positives")

    # A block's anchors have their positives beside them, by their places.
    place = blocks.select("number", F.posexplode("ids").alias("place", "anchor_id"))
    asked = blocks.join(place.join(near, "anchor_id").groupBy("number").agg(F.collect_list(F.struct("place", "k", "positive_id", "positive_score")).alias("wanted")), "number")
    pairs = tiles.withColumn("block", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>")))

    def ranges(block_):
        """(ids, scores, least and largest score of a negative) of each anchor's positives; where there is none, no score fits."""
        if not hasattr(block_, "asked"):
            wanted = block_.row.column("a_wanted").flatten()
            at, k, ids, score = (np.asarray(wanted.field(c)) for c in ("place", "k", "positive_id", "positive_score"))
            block_.asked = [np.full((len(block_.ids), positives), fill) for fill in (0, 0, 1, 0)]
            for values, into in zip((ids, score, -(-low * score // 100), high * score // 100), block_.asked):
                into[at, k - 1] = values
        return block_.asked

    def other_label(block_, a, least, ids, labels, s):
        other, found = labels[:, None] != block_.labels[a], []
        lo, hi = (x[a] for x in ranges(block_)[2:])
        lo = np.maximum(lo, least.reshape(-1, positives))
        for k in range(positives):
            i, j = np.nonzero((s >= lo[:, k]) & (s <= hi[:, k]) & other)
            found.append((j * positives + k, i, j))
        return tuple(map(np.concatenate, zip(*found)))

    def negatives_of(block_):
        anchor, k, ids, found = _found(block_, positives)
        asked_ids, asked_scores = ranges(block_)[:2]
        columns = [block_.ids[anchor], asked_ids[anchor, k], ids, asked_scores[anchor, k], found]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    far = _dealt(pairs, asked, n_rows, len(numbers)).mapInArrow(lambda b: _best_of(b, positives, negatives, other_label, negatives_of), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select anchor_id, other_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, other_id) as k from s where same) where k <= 5),
n as (select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id))::int as rank, other_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from n where rank <= 10"""
