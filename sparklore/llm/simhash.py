"""Operator 4: SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. Of up to 4 differing bits, at most 2 lie
in some two of the blocks, and then a word exists there that differs from either fingerprint in at most
one bit. The anchors of two blocks are pairs of codewords of the perfect binary Golay code (covering
radius 3 a block): a fingerprint goes to the anchor of every word within one bit of its two blocks, that
is to anchors within covering radius plus half the threshold, so two linked fingerprints share the anchor
of the word between them. About 29 of 3 * 2**24 anchors hold a fingerprint; each anchor's are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, stored
from .components import connected_components

THRESHOLD = 4
#: Fingerprints of an anchor that are compared in one go; anchors with more are compared in tiles of this size.
TILE = 1024
#: Generator of the binary Golay code of length 23 (fixed value).
GENERATOR = 0b101011100011
BLOCKS = ((0, 23), (23, 23), (46, 18))


def fingerprint(data: bytes, width: int = 4) -> int:
    """SimHash of UTF-8 ``data``: ASCII lower case, words between ASCII white space, ``width``-word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[width - 1 :] or [len(line)]
    n, ones, digest = len(ends), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        part = ends[at : at + (1 << 16)]
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:], part)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``name`` (replaced if there), the fingerprint of the whole text. Null and wordless texts: 0."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo GENERATOR (polynomials over GF(2))."""
    out = values.copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


def golay_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of each byte of a word, and the error of weight up to 3 that each remainder stands for."""
    by_byte = [_remainders(np.arange(256, dtype=np.int64) << 8 * k & (1 << 23) - 1) for k in range(3)]
    errors = np.array([sum(1 << i for i in bits) for w in range(4) for bits in combinations(range(23), w)], dtype=np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[_remainders(errors)] = errors
    return by_byte, table


_TABLES: list = []


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    if not _TABLES:
        _TABLES.append(golay_tables())
    by_byte, errors = _TABLES[0]
    return words ^ errors[by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the fingerprint, anchor) for every anchor that each of ``prints`` goes to, without repeats."""
    bits = prints.astype(np.int64)
    blocks = [bits >> lo & (1 << n) - 1 for lo, n in BLOCKS]
    near = [np.stack([nearest_codeword(b), *(nearest_codeword(b ^ 1 << i) for i in range(n))], axis=1) for b, (_, n) in zip(blocks, BLOCKS)]
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        both = np.concatenate([near[i] << 23 | near[j][:, :1], near[i][:, :1] << 23 | near[j][:, 1:]], axis=1) | k << 46
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest with the components of links (a, b) over 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    v = np.flatnonzero(label != np.arange(n))
    return v, label[v]


def links_of_sorted(keys: list[np.ndarray], prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among equal ``keys`` (rows sorted by them) of fingerprints within ``threshold`` bits."""
    n, a, b, held, step = len(prints), [], [], 0, 1
    at = np.arange(n)
    while len(at := at[at + step < n]):
        for k in keys:
            at = at[k[at] == k[at + step]]
        hit = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= threshold]
        a.append(hit)
        b.append(hit + step)
        held += len(hit)
        if held > 2_000_000:
            x, y = _forest(np.concatenate(a), np.concatenate(b), n)
            a, b, held = [x], [y], len(x)
        step += 1
    if not held:
        return at[:0], at[:0]
    return _forest(np.concatenate(a), np.concatenate(b), n)


def links(classes: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``classes`` that give the same components as all links."""
    if threshold > THRESHOLD:
        raise ValueError("anchors cover up to 4 differing bits")

    def spread(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for at in range(0, len(prints), 2048):
                part = prints[at : at + 2048]
                rows, keys = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["anchor", "print"])

    spread_out = stored(classes.select("fingerprint").mapInArrow(spread, "anchor long, print long"), "simhash_anchors")
    counts = spread_out.groupBy("anchor").count()
    hot = stored(counts.where(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).alias("tiles")), "simhash_hot")
    # Both sides are read from storage, so that a hot anchor's exchange can be split.
    held = spread_out.join(hot, "anchor", "left")
    mine = F.coalesce(F.pmod(F.xxhash64("print"), F.col("tiles")), F.lit(0))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tiles") - 1, F.lit(0))))
    dealt = held.withColumn("mine", mine).withColumn("other", other).select("anchor", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "print")

    def compare(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), bool)
            for k in cols[:3]:
                last &= k == k[-1]
            cut = len(last) - int(last.sum())
            rest = [c[cut:] for c in cols]
            if cut:
                yield found([c[:cut] for c in cols])
        if rest is not None:
            yield found(rest)

    def found(cols):
        x, y = links_of_sorted(cols[:3], cols[3].view(np.uint64), threshold)
        return pa.RecordBatch.from_arrays([pa.array(cols[3][x]), pa.array(cols[3][y])], names=["a", "b"])

    keys = ["anchor", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(fingerprint, component, component_id) for every distinct fingerprint of ``prints``.

    ``component`` is the smallest fingerprint reachable by links of up to ``threshold`` bits,
    ``component_id`` the smallest id of its rows. Null ids are larger than any; a component of null ids
    alone has a null id. Copies are one fingerprint here, so that groups of them cost nothing. Empty in,
    empty out; columns besides the id and the fingerprint are ignored.
    """
    classes = stored(prints.groupBy("fingerprint").agg(F.min(id_col).alias("id")), "simhash_classes")
    edges = links(classes, threshold)
    roots = stored(connected_components(edges).select(F.col("node").alias("fingerprint"), F.col("root").alias("component")), "simhash_roots")
    member = stored(classes.join(roots, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), "simhash_member")
    ids = stored(member.groupBy("component").agg(F.min("id").alias("component_id")), "simhash_ids")
    return member.join(ids, "component").select("fingerprint", "component", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``; the fingerprint as 16 hexadecimal digits.

    Null and wordless texts have fingerprint 0, which links like any other. Null ids and rows that repeat keep
    their rows (see ``near_duplicates``). Other columns are ignored; empty in, empty out.
    """
    prints = stored(with_fingerprint(docs.select(id_col, text_col), text_col).select(id_col, "fingerprint"), "simhash_prints")
    groups = stored(near_duplicates(prints, id_col, threshold), "simhash_groups")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(groups, "fingerprint").select(id_col, digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the row of the smallest id of each group alone; of rows that repeat it, one.

    Null ids are larger than any other: a group of them alone keeps one row. Null and wordless texts are one
    group. Columns are as they were, whatever their names. Empty in, empty out.
    """
    mark = fresh(docs, "simhash")
    marked = stored(with_fingerprint(docs, text_col, mark), "simhash_marked")
    prints = marked.select(F.col(id_col).alias("id"), F.col(mark).alias("fingerprint"))
    groups = stored(near_duplicates(prints, "id", threshold), "simhash_groups")
    own = prints.groupBy("fingerprint").agg(F.min("id").alias("id"))
    best = groups.join(own, "fingerprint").where(F.col("id").eqNullSafe(F.col("component_id")))
    least = fresh(marked, "least")
    best = best.groupBy("component").agg(F.min(F.struct("id", "fingerprint")).alias("x")).select(F.col("x.fingerprint").alias(mark), F.col("x.id").alias(least))
    kept = marked.join(best, (marked[mark] == best[mark]) & marked[id_col].eqNullSafe(best[least])).drop(best[mark])
    return kept.dropDuplicates([mark, least]).select(*docs.columns)
