"""Operator 8: embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class first. Classes of a label are dealt to tiles of bounded size and
every pair of tiles is one group: a matrix product of int8 codes, which with both vectors' error bounds tells
most pairs to be over or under the threshold for sure. Codes alone are sent to every tile. Vectors that have
a pair in doubt follow to just those tile pairs, where such pairs are computed in double precision. A group
returns a link count for each vector and a forest, never its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components
from .simhash import _forest

THRESHOLD = 0.93
#: Classes of a tile, on average.
TILE = 2048
#: Rows of a tile that are multiplied at a time.
ROWS = 512


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are brought near 1 by a power of two first (which is exact), so no square is too large or small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error bound of each unit vector: |unit - scale * code| <= bound."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - scale[:, None] * codes, axis=1) + 1e-9


def _blocks(x: tuple, y: tuple | None, threshold: float):
    """(index of x, index of y, whether surely linked) of the pairs of codes that may be linked, block by block; y None: i < j within x."""
    (p, s, d), (q, t, e) = x, x if y is None else y
    kind = np.float32 if p.shape[1] <= 1040 else np.float64  # products of int8 codes are whole numbers, exact here
    right = q.astype(kind).T
    for at in range(0, len(p), ROWS):
        k = slice(at, at + ROWS)
        product = (p[k].astype(kind) @ right) * s[k, None] * t
        error = d[k, None] + (1 + d[k, None]) * e + 1e-5
        i, j = np.nonzero(product + error >= threshold)
        if y is None:
            later = i + at < j
            i, j = i[later], j[later]
        yield i + at, j, (product - error)[i, j] >= threshold


def sure_links(x: tuple, y: tuple | None, threshold: float):
    """(linked i, linked j, doubtful i, doubtful j) by (codes, scales, bounds) alone, block by block."""
    for i, j, sure in _blocks(x, y, threshold):
        yield i[sure], j[sure], i[~sure], j[~sure]


def close_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """(i, j) of the pairs that codes leave in doubt and whose cosine in double precision is at least ``threshold``."""
    u = unit_vectors(x)
    v = u if y is None else unit_vectors(y)
    for i, j, sure in _blocks(quantise(u), None if y is None else quantise(v), threshold):
        i, j = i[~sure], j[~sure]
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            linked = np.einsum("ij,ij->i", u[a], v[b]) >= threshold
            yield a[linked], b[linked]


class Links:
    """Link counts and a forest over the ``n`` vectors of a group, from index pairs as they come."""

    def __init__(self, n: np.ndarray):
        self.n, self.gained, self.pairs, self.held = n, np.zeros(len(n), np.int64), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.gained, i, self.n[j])
        np.add.at(self.gained, j, self.n[i])
        self.pairs, self.held = [*self.pairs, (i, j)], self.held + len(i)
        if self.held > 2_000_000:
            self.pairs = [self._joined()]
            self.held = len(self.pairs[0][0])

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        return _forest(*(np.concatenate(c) for c in zip(*self.pairs)), len(self.n))

    def table(self, nodes: list[bytes]) -> dict:
        up = np.arange(len(self.n))
        if self.held:
            v, root = self._joined()
            up[v] = root
        at = np.flatnonzero(self.gained)
        return {"node": pa.array([nodes[i] for i in at], pa.binary()), "gained": pa.array(self.gained[at]), "up": pa.array([nodes[up[i]] for i in at], pa.binary())}


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, node, label, dim, vector): ``node`` identifies label and vector; null where nothing can link."""
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    kind = pa.float32() if element == "float" else pa.float64()

    def run(batches):
        for batch in batches:
            labels, vectors_ = batch.column(1).to_pylist(), batch.column(2)
            valid = vectors_.is_valid().to_numpy(zero_copy_only=False)
            # flatten() leaves out what null entries hold; nulls within a vector become NaN, and -0.0 counts as 0.0
            values = vectors_.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            sizes = vectors_.value_lengths().fill_null(0)
            ends, nodes = np.cumsum(sizes.to_numpy()).tolist(), []
            for start, end, known, label in zip([0, *ends], ends, valid, labels):
                v = values[start:end]
                ok = known and label is not None and end > start and np.isfinite(v).all() and v.any()
                nodes.append(hashlib.blake2b(v.tobytes() + repr(label).encode(), digest_size=16).digest() if ok else None)
            columns = [batch.column(0), pa.array(nodes, pa.binary()), batch.column(1), sizes.cast(pa.int32()), vectors_.cast(pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "label", "dim", "vector"])

    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows = vectors.select(id_col, label_col, F.col(vector_col).cast(f"array<{element}>").alias("v"))
    return rows.mapInArrow(run, f"id {id_kind}, node binary, label {label_kind}, dim int, vector array<{element}>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def coded(classes: DataFrame) -> DataFrame:
    """``classes`` (node, n, label, dim, vector) with ``code``, ``scale`` and ``bound`` in place of the vector."""

    def run(batches):
        for batch in batches:
            scales, bounds = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            dims = np.asarray(batch.column("dim"))
            codes = np.empty(batch.num_rows, object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c, scales[at], bounds[at] = quantise(unit_vectors(_matrix(batch.column("vector").take(pa.array(at)))))
                for k, row in zip(at, c):
                    codes[k] = row.tobytes()
            kept = [batch.column(c) for c in ("node", "n", "label", "dim")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes.tolist(), pa.binary()), pa.array(scales), pa.array(bounds)], names=["node", "n", "label", "dim", "code", "scale", "bound"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "n", "label", "dim", "vector").mapInArrow(run, f"node binary, n long, label {label}, dim int, code binary, scale double, bound double")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold`` (over
    0). Null, empty or zero vectors and those with null or non-finite components link with nothing, and
    are components of their own. Vectors of different lengths never link. Equal rows are counted each.
    A null id is no component's smallest. Columns besides the three are ignored; empty in, empty out.
    """
    rows = classes_of(vectors, id_col, vector_col, label_col)
    light = stored(rows.select("id", "node"), "embedding_rows")
    classes = stored(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "embedding_classes")
    sizes = stored(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).alias("tiles")), "embedding_sizes")
    placed = coded(classes).join(sizes, ["label", "dim"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = placed.withColumn("other", other).select("label", "dim", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "n", "code", "scale", "bound")
    keys = ["label", "dim", "lo", "hi"]

    def halves(group: pa.Table):
        """(nodes, n, indices of the lower tile, indices of the other one or None where both are the same)."""
        lo, hi = (group.column(c)[0].as_py() for c in ("lo", "hi"))
        first = group.column("mine").to_numpy() == lo
        return group.column("node").to_pylist(), group.column("n").to_numpy(), np.flatnonzero(first), None if lo == hi else np.flatnonzero(~first)

    def by_codes(group: pa.Table) -> pa.Table:
        """Links that are sure, and (with ``doubt``) the vectors that have a pair in doubt here."""
        nodes, n, left, right = halves(group)
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(len(nodes), -1)
        side = lambda at: (codes[at], group.column("scale").to_numpy()[at], group.column("bound").to_numpy()[at])
        links, doubt = Links(n), np.zeros(len(nodes), bool)
        if len(left) and (right is None or len(right)):
            for i, j, x, y in sure_links(side(left), None if right is None else side(right), threshold):
                links.add(left[i], (left if right is None else right)[j])
                doubt[left[x]] = doubt[(left if right is None else right)[y]] = True
        out, at = links.table(nodes), np.flatnonzero(doubt)
        same = {c: pa.repeat(group.column(c)[0], len(at)) for c in keys}
        found = pa.table({**out, "doubt": pa.repeat(pa.scalar(False), len(out["node"])), **{c: pa.nulls(len(out["node"]), v.type) for c, v in same.items()}, "mine": pa.nulls(len(out["node"]), pa.int64()), "n": pa.nulls(len(out["node"]), pa.int64())})
        wanted = {"node": pa.array([nodes[i] for i in at], pa.binary()), "gained": pa.nulls(len(at), pa.int64()), "up": pa.nulls(len(at), pa.binary()), "doubt": pa.repeat(pa.scalar(True), len(at)), **same}
        wanted |= {c: pa.array(group.column(c).to_numpy()[at]) for c in ("mine", "n")}
        return pa.concat_tables([found, pa.table(wanted).select(found.column_names)])

    def in_full(group: pa.Table) -> pa.Table:
        nodes, n, left, right = halves(group)
        x, links = _matrix(group.column("vector")), Links(n)
        if len(left) and (right is None or len(right)):
            for i, j in close_links(x[left], None if right is None else x[right], threshold):
                links.add(left[i], (left if right is None else right)[j])
        return pa.table(links.table(nodes))

    label = classes.schema["label"].dataType.simpleString()
    told = stored(dealt.groupBy(*keys).applyInArrow(by_codes, f"node binary, gained long, up binary, doubt boolean, label {label}, dim int, lo long, hi long, mine long, n long"), "embedding_told")
    doubtful = told.where("doubt").select(*keys, "mine", "node", "n").join(classes.select("node", "vector"), "node")
    closer = doubtful.groupBy(*keys).applyInArrow(in_full, "node binary, gained long, up binary")
    found = stored(told.where("not doubt").select("node", "gained", "up").unionByName(closer), "embedding_links")
    gained = found.groupBy("node").agg(F.sum("gained").alias("gained"))
    roots = connected_components(found.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b")))
    member = stored(classes.select("node", "n", "least").join(gained, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "embedding_member")
    ids = stored(member.groupBy("root").agg(F.min("least").alias("component")), "embedding_ids")
    member = stored(member.join(ids, "root").select("node", (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "component"), "embedding_class_links")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    out = light.join(member, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id as node, vec_id as reached from v union select r.node, l.b from r join l on r.reached = l.a),
c as (select node, min(reached) as component_id from r group by 1),
n as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join n on vec_id = a left join c on vec_id = node"""
