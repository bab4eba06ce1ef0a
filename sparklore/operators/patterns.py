"""What users repeat across sessions: similar messages and corrections, clustered around leaders.

Similarity is Jaccard on token sets. Two messages of n and m tokens and of similarity t or more share at least
``o = ceil((n + m) t / (1 + t))`` of them. Tokens are ordered by how many messages hold them, the rarest first: min(l, o) of
those shared are among the first ``n - o + l`` of the one and the first ``m - o + l`` of the other, which are fewer the further
the sizes are apart. Sets are dealt to blocks by size, and two blocks whose sizes may do meet in one task. It indexes the
smaller sets, looks the larger ones up, by classes of their size that see less and less of the index, and counts the indexed
tokens that are shared. A pair is dropped unless its count and the tokens that the one whose index ends first has beyond
it could be enough; of what is left all tokens are counted. A larger l means more to count and far fewer pairs to compare:
it is the largest whose pairs in the index, known from how often each token is indexed, are little more than those of
l = 1. Only similar pairs leave a task: what is shuffled are the sets, coded in some bytes a token, once for each block
that theirs meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PatternConfig
from ..functions import text as X
from ..shared import checkpointed
from .ordered import last_before

#: Phrases that mark a correction.
CORRECTIONS = ("no,", "no.", "not that", "i said", "i told you", "i meant", "wrong", "that's not", "don't do that", "stop", "undo", "actually,", "instead,", "please don't", "i already said", "as i mentioned", "like i said", "again,", "remember to", "always ", "never ", "you forgot", "you missed", "you need to")
INSTRUCTION, CORRECTION = "repeated-instruction", "repeated-correction"
#: Tokens of a block's sets on average, what a set counts besides them, and blocks that there are at least, for work to be dealt in.
TILE, EACH, BLOCKS = 40_000_000, 32, 10
#: Places that sets of one size may have.
SHARES = 1_000_003
#: Classes of sizes that see less and less of an index, and sets that are looked up together.
CLASSES, ROWS = 6, 2000
#: An index that meets a set in more than one of so many of its places is counted, else sorted.
DENSE = 5
#: Shared tokens to count (l) that are tried, and how many pairs more than those of the first the index may bring together.
COUNTED, MORE = (1, 2, 4, 8, 16), 1.25
#: Tokens, the most frequent ones, whose frequency every task knows (16 bytes each); others count as rare.
COMMON = 1 << 20
#: Pairs that a task gathers before it hands them on.
PAIRS = 100_000
#: Links between undecided messages that the driver goes through one by one, instead of further rounds.
FEW = 20_000


def user_messages(turns: DataFrame) -> DataFrame:
    """User turns (context_id, turn_id, kind, text) with scrubbed text that is not blank and has three tokens or more."""
    rows = turns.where("kind = 'user_input'").withColumn("text", X.scrub(F.col("text")))
    rows = rows.withColumn("tokens", X.tokens(F.col("text")))
    return rows.where((X.trim_space(F.col("text")) != "") & (F.size("tokens") >= 3))


def is_correction(text: Column) -> Column:
    return X.contains_any(F.lower(text), CORRECTIONS)


def preceding_action(turns: DataFrame) -> DataFrame:
    """``turns`` with ``agent_action``: the last agent turn before that is not blank, cut to 200 bytes, scrubbed."""
    agent = F.col("kind").isin("assistant", "assistant_turn", "tool_call") & (X.trim_space(F.col("text")) != "")
    rows = last_before(turns, "context_id", "turn_id", F.when(agent, F.col("text")), "__last")
    cut = F.when(F.octet_length("__last") > 200, F.concat(X.truncate_bytes(F.col("__last"), 200), F.lit("..."))).otherwise(F.col("__last"))
    return rows.withColumn("agent_action", F.coalesce(X.scrub(cut), F.lit(""))).drop("__last")


def corrections(turns: DataFrame) -> DataFrame:
    """(context_id, turn_id, text, agent_action) of user turns that correct the agent."""
    rows = preceding_action(turns).where((F.col("kind") == "user_input") & is_correction(F.col("text")))
    return rows.select("context_id", "turn_id", X.scrub(F.col("text")).alias("text"), "agent_action")


def _keyed(messages: DataFrame) -> DataFrame:
    """(idx, set, key): distinct tokens, and a digest of them where there are any."""
    keyed = messages.select("idx", F.sort_array(F.array_distinct("tokens")).alias("set"))
    return keyed.withColumn("key", F.when(F.size("set") > 0, F.unhex(F.sha2(F.array_join("set", "\n"), 256))))


def _represented(keyed: DataFrame) -> DataFrame:
    reps = keyed.where("key is not null").groupBy("key").agg(F.min("idx").alias("rep"))
    return keyed.join(checkpointed(reps), "key", "left").select("idx", F.coalesce("rep", "idx").alias("rep"))


def classes(messages: DataFrame) -> DataFrame:
    """(idx, rep): messages (idx, tokens) of equal token sets share the smallest idx; those without tokens have their own."""
    return _represented(_keyed(messages))


def similar_pairs(messages: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(i, j, similarity) for i < j, of class representatives with Jaccard similarity of at least ``threshold``.

    Messages (idx, tokens) of equal token sets are one class (see ``classes``); its copies are not paired.
    """
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    return _pairs(_coded(messages), threshold, tile)


def _coded(messages: DataFrame) -> DataFrame:
    """(idx, key, n, own, rare, common): token sets in a few bytes a token, of which equal ones have one ``key``; those without tokens have none.

    ``common`` are ranks of the most frequent tokens (at most ``COMMON``), rising with frequency, ``rare`` hashes of others that stand before
    them. Where every token that two messages hold is common, others are just counted (``own``). Hashes tell tokens apart: a
    seed under which two tokens have one hash is not used.
    """
    keyed = _keyed(messages)
    for seed in count():
        hashes = F.coalesce(F.transform("set", lambda w: F.xxhash64(w, F.lit(seed))), F.array().cast("array<bigint>"))
        checks = F.coalesce(F.transform("set", lambda w: F.hash(w)), F.array().cast("array<int>"))
        counts = keyed.select(hashes.alias("hashes"), checks.alias("checks")).mapInArrow(_tallied, "token long, df long, low int, high int")
        counts = counts.groupBy("token").agg(F.sum("df").alias("df"), (F.min("low") != F.max("high")).alias("clash")).where("df > 1")
        counts = checkpointed(counts)
        if counts.where("clash").isEmpty():
            break
    spread = counts.groupBy(F.least("df", F.lit(COMMON)).alias("df")).agg(F.count("*").alias("tokens")).orderBy(F.desc("df"))
    held, least = 0, None
    for r in spread.collect():  # a row a frequency
        held += r.tokens
        if held > COMMON:
            break
        least = r.df
    complete = held <= COMMON
    known = counts.where(F.col("df") >= least).select("token", "df").toArrow() if least else counts.limit(0).select("token", "df").toArrow()
    token, df = known["token"].to_numpy(), known["df"].to_numpy()
    rank = np.empty(len(token), np.int32)
    rank[np.lexsort((token, df))] = np.arange(len(token), dtype=np.int32)
    order = np.argsort(token)
    context = messages.sparkSession.sparkContext
    tokens, ranks = context.broadcast(token[order]), context.broadcast(rank[order])

    def run(batches):
        for batch in batches:
            held = batch.column("hashes")
            values, sizes = held.flatten().to_numpy(zero_copy_only=False), np.asarray(held.value_lengths())
            at = np.minimum(np.searchsorted(tokens.value, values), max(0, len(tokens.value) - 1))
            found = tokens.value[at] == values if len(tokens.value) else np.zeros(len(values), bool)
            own, rare, common, start = [], [], [], 0
            for n in sizes.tolist():
                here = found[start : start + n]
                codes = np.sort(ranks.value[at[start : start + n][here]])
                steps = np.diff(codes, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T
                common.append(zlib.compress(steps.tobytes(), 1))
                others = n - len(codes)
                own.append(others if complete else 0)
                rare.append(b"" if complete else np.sort(values[start : start + n][~here]).astype("<i8").tobytes())
                start += n
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("key"), pa.array(sizes.astype(np.int32)), pa.array(own, pa.int32()), pa.array(rare, pa.binary()), pa.array(common, pa.binary())], names=["idx", "key", "n", "own", "rare", "common"])

    hashed = keyed.select("idx", "key", hashes.alias("hashes"))
    schema = T.StructType([messages.schema["idx"], *T.StructType.fromDDL("key binary, n int, own int, rare binary, common binary").fields])
    return checkpointed(hashed.mapInArrow(run, schema))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, df, low, high) of each batch's (hashes, checks): how often a hash is there, its smallest and its largest check."""
    for batch in batches:
        values, checks = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("hashes", "checks"))
        if not len(values):
            continue
        order = np.argsort(values)
        values, checks = values[order], checks[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        columns = values[starts], np.diff(np.append(starts, len(values))), np.minimum.reduceat(checks, starts), np.maximum.reduceat(checks, starts)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "df", "low", "high"])


def _pairs(coded: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(i, j, similarity) of ``similar_pairs`` from ``_coded`` sets."""
    values = ["n", "own", "rare", "common"]
    held = coded.where("key is not null")
    sizes = held.groupBy("n").agg(F.countDistinct("key").alias("sets")).orderBy("n").collect()  # a row a size
    bounds, ranges = _blocks([(r.n, r.sets) for r in sizes], tile)
    reach = [(min((b for b in range(k) if ranges[b][1] >= low * threshold - 1e-9), default=k), max((b for b in range(k, len(ranges)) if ranges[b][0] * threshold - 1e-9 <= high), default=k)) for k, (low, high) in enumerate(ranges)] or [(0, 0)]
    blocks = len(reach)
    sets = held.groupBy("key").agg(F.min("idx").alias("idx"), *[F.first(c).alias(c) for c in values])
    place = F.col("n") + F.pmod(F.xxhash64("key"), F.lit(SHARES)) / SHARES
    listed = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    sets = sets.select("key", "idx", *values, place.alias("place")).withColumn("block", F.size(F.filter(listed(bounds, "double"), lambda b: b <= F.col("place"))))
    first, last = (F.element_at(listed([r[side] for r in reach], "int"), F.col("block") + 1) for side in (0, 1))
    dealt = sets.drop("place").withColumn("other", F.explode(F.sequence(first, last)))
    dealt = dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other")
    tasks = min(2 * blocks * (blocks + 1), max(200, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        idx = table["idx"].combine_chunks()
        for x, y, similarity in _similar(table, threshold):
            yield pa.RecordBatch.from_arrays([idx.take(pa.array(x)), idx.take(pa.array(y)), pa.array(similarity)], names=["x", "y", "similarity"])

    kind = coded.schema["idx"].dataType
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("similarity", T.DoubleType())])
    found = dealt.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(run, schema)  # few bytes, much work
    return found.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")


def _blocks(sizes: list[tuple[int, int]], tile: int) -> tuple[list[float], list[tuple[int, int]]]:
    """Where blocks begin, and the smallest and largest size of each, for ``sizes`` (n, sets) in order.

    A set of n tokens stands at n and a share of 1 that its key gives, so that one size may be dealt to several blocks.
    """
    sets, tokens = sum(c for _, c in sizes), sum((n + EACH) * c for n, c in sizes)
    blocks = max(1, min(sets, max(BLOCKS, -(-tokens // tile))))
    bounds, held, ends = [], 0, []
    for n, c in sizes:
        mass = (n + EACH) * c
        while len(bounds) < blocks - 1 and held + mass > (goal := tokens * (len(bounds) + 1) / blocks):
            bounds.append(n + (goal - held) / mass)
        held, ends = held + mass, [*ends, n]
    if not sizes:
        return [], []
    edges = [float(sizes[0][0]), *bounds, float(sizes[-1][0] + 1)]
    # A block's sizes as its bounds tell them; one that begins at a whole number has none of the size before.
    return bounds, [(int(a), max(int(a), int(np.ceil(b)) - 1)) for a, b in zip(edges, edges[1:])]


def _flat(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the items of ``rows`` stand, one row after the other."""
    n = sizes[rows]
    return np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)


def _decoded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rows' rare tokens, and how many each has; ranks of the common ones, and how many."""
    rare = table["rare"].to_pylist()
    common = [np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().cumsum(dtype=np.int32) for b in table["common"].to_pylist()]
    n_rare, n_common = (np.fromiter((len(b) // w for b in part), np.int64, len(part)) for part, w in ((rare, 8), (common, 1)))
    return np.frombuffer(b"".join(rare), "<i8"), n_rare, np.concatenate([*common, np.empty(0, np.int32)]), n_common


def _joined(rare: np.ndarray, n_rare: np.ndarray, common: np.ndarray, n_common: np.ndarray) -> np.ndarray:
    """Codes row by row: a row's rare ones, then its common ones."""
    sizes = n_rare + n_common
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = inside < np.repeat(n_rare, sizes)
    out = np.empty(len(first), np.int32)
    out[first], out[~first] = rare, common
    return out


def _similar(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, similarities) of the similar pairs of two blocks' sets, or of one block's own.

    Sets of the block of smaller sizes are indexed, those of the other, none of them smaller, are looked up.
    """
    block, size = table["block"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    p, q = table["p"][0].as_py(), table["q"][0].as_py()
    order = pa.compute.sort_indices(table.select(["n", "key"]), [("n", "ascending"), ("key", "ascending")]).to_numpy()
    right = order[block[order] == p]
    left = right if p == q else order[block[order] == q]
    if not len(left) or not len(right):
        return
    share = threshold / (1 + threshold)
    shared = lambda a, b: np.ceil((a + b) * share - 1e-9).astype(np.int64)
    own_of = table["own"].to_numpy().astype(np.int64)
    n, own = size[right], own_of[right]
    held = table.take(pa.array(right)).select(["rare", "common"])
    rare, n_rare, common, n_common = _decoded(held)
    del held
    names = np.unique(rare)
    codes = _joined(np.searchsorted(names, rare), n_rare, common + np.int32(len(names)), n_common)
    most = max(len(names) + int(common.max(initial=-1)) + 1, 1)
    sizes = n_rare + n_common
    starts = np.cumsum(sizes) - sizes
    del rare, common

    # Sizes from which on sets that are looked up use less of the index: classes of them.
    low, high = size[left[0]], min(size[left[-1]], int((n[-1] + 1e-9) / threshold))
    if low > high:
        return
    classes = np.unique(np.floor(low * (high / low) ** (np.arange(CLASSES) / CLASSES)).astype(np.int64))
    kept = lambda prefix, own, sizes: np.clip(prefix - own, 0, sizes)

    def cost(l):  # noqa: E741
        index = kept(n - shared(n, np.maximum(n, low)) + l, own, sizes)
        b = np.bincount(codes[_flat(np.arange(len(n)), starts, index)], minlength=1).astype(float)
        return b @ b

    costs = {}
    for l in COUNTED:  # noqa: E741
        costs[l] = cost(l)
        if costs[l] > MORE * costs[COUNTED[0]]:
            break
    counted = max(l for l in costs if costs[l] <= MORE * costs[COUNTED[0]])  # noqa: E741
    prefixes = [np.minimum(n, n - shared(n, np.maximum(n, c)) + counted) for c in classes]
    indexes = [kept(prefix, own, sizes) for prefix in prefixes]
    # Postings of a token stand together, those that most classes use first.
    bits, levels = max(1, int(len(n) - 1).bit_length()), int(len(classes)).bit_length()
    widest = indexes[0]
    packed = codes[_flat(np.arange(len(n)), starts, widest)].astype(np.int64) << levels
    inside = np.arange(widest.sum()) - np.repeat(np.cumsum(widest) - widest, widest)
    for index in indexes[1:]:
        packed += inside >= np.repeat(index, widest)
    del inside
    packed = (packed << bits) | np.repeat(np.arange(len(n)), widest)
    packed.sort()
    posted = (packed & ((1 << bits) - 1)).astype(np.int32)
    packed >>= bits
    begins = np.searchsorted(packed, np.arange(most, dtype=np.int64) << levels).astype(np.int32)
    # The last level that class k uses is len(classes) - 1 - k.
    ends = [np.searchsorted(packed, (np.arange(most, dtype=np.int64) << levels) + (len(classes) - 1 - k), "right").astype(np.int32) for k in range(len(classes))]
    del packed
    lasts = [np.where(index > 0, 2 * codes[np.minimum(starts + np.maximum(index, 1) - 1, len(codes) - 1)].astype(np.int64) + 1 if len(codes) else -1, -1) for index in indexes]

    marks, out, gathered = np.zeros(most, bool), [], 0
    for begin in range(0, len(left), ROWS):
        rows = left[begin : begin + ROWS]
        nx, ownx = size[rows], own_of[rows]
        rare, n_rare, common, n_common = _decoded(table.take(pa.array(rows)).select(["rare", "common"]))
        at = np.searchsorted(names, rare)
        known = names[np.minimum(at, max(0, len(names) - 1))] == rare if len(names) else np.zeros(len(rare), bool)
        # Twice a code and 1 where the block has the token; a token that it lacks stands between codes.
        mine = _joined(2 * at + known, n_rare, 2 * (common + np.int32(len(names))) + 1, n_common)
        sizex = n_rare + n_common
        startx = np.cumsum(sizex) - sizex
        kind = np.searchsorted(classes, nx, "right") - 1
        # Smallest sets that may do.
        least = np.maximum(n[0], np.ceil(nx * threshold - 1e-9).astype(np.int64))
        prefix = np.minimum(nx, nx - shared(nx, least) + counted)
        index = np.where(least <= n[-1], kept(prefix, ownx, sizex), 0)
        lastx = np.where(index > 0, mine[np.minimum(startx + np.maximum(index, 1) - 1, max(0, len(mine) - 1))] if len(mine) else -1, -1)
        floor = np.searchsorted(n, least)
        enough = np.clip(shared(nx, least), 1, counted)
        held = (mine & 1 == 1) & (mine >> 1 < most)
        row = np.repeat(np.arange(len(rows)), index)
        asked = mine[_flat(np.arange(len(rows)), startx, index)]
        some = (asked & 1 == 1) & (asked >> 1 < most)
        row, asked = row[some], asked[some] >> 1
        a, b = begins[asked], np.empty(len(asked), np.int32)
        for k in np.unique(kind[row]):
            here = kind[row] == k
            b[here] = ends[k][asked[here]]
        some = b > a
        row, a, b = row[some], a[some].tolist(), b[some].tolist()
        edges = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        xs, ys, mets = [], [], []
        for x, (e, f) in enumerate(zip(edges, edges[1:])):
            if e == f:
                continue
            met = np.concatenate([posted[c:d] for c, d in zip(a[e:f], b[e:f])])
            c = int(enough[x])
            if len(met) < c:
                continue
            if DENSE * len(met) > len(n):
                met = np.bincount(met)
                y = np.flatnonzero(met >= c)
                met = met[y]
            else:
                met.sort()
                y = met[c - 1 :][met[c - 1 :] == met[: len(met) - c + 1]]
                if not len(y):
                    continue
                y = y[np.append(True, y[1:] != y[:-1])]
                met = np.searchsorted(met, y, "right") - np.searchsorted(met, y)
            if len(y):
                xs.append(np.full(len(y), x))
                ys.append(y)
                mets.append(met)
        if not xs:
            continue
        x, y, met = np.concatenate(xs), np.concatenate(ys), np.concatenate(mets)
        # Tokens that such a pair shares at least, less those of the set whose index ends first that are beyond it.
        some = (y >= floor[x]) & ((begin + x > y) if p == q else True)
        x, y, met = x[some], y[some], met[some]
        need = shared(nx[x], n[y])
        beyond_x, beyond_y, end_x, end_y = (nx - prefix)[x], np.empty(len(y), np.int64), lastx[x], np.empty(len(y), np.int64)
        for k in np.unique(kind[x]):
            here = kind[x] == k
            beyond_y[here], end_y[here] = (n - prefixes[k])[y[here]], lasts[k][y[here]]
        need -= np.where(end_x < end_y, beyond_x, np.where(end_y < end_x, beyond_y, np.minimum(beyond_x, beyond_y)))
        some = met >= need
        x, y = x[some], y[some]
        edges = np.searchsorted(x, np.arange(len(rows) + 1))
        for r in np.unique(x):
            whole = slice(startx[r], startx[r] + sizex[r])
            token = mine[whole][held[whole]] >> 1
            marks[token] = True
            others = y[edges[r] : edges[r + 1]]
            for part in np.split(others, range(1000, len(others), 1000)):
                both = np.add.reduceat(marks[codes[_flat(part, starts, sizes)]], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                similarity = both / (nx[r] + n[part] - both)
                good = similarity >= threshold
                if good.any():
                    out.append((np.full(good.sum(), rows[r]), right[part[good]], similarity[good]))
                    gathered += len(out[-1][0])
            marks[token] = False
            if gathered >= PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*out))
                out, gathered = [], 0
    if out:
        yield tuple(np.concatenate(c) for c in zip(*out))


def _along(single: DataFrame) -> DataFrame:
    """(v, r, flip): ``single`` (v, r, flip) with each row's chain followed to its end: v leads as r does, or not as it does with ``flip``.

    Every step composes a row with that of its own end, so a chain is followed in as many steps as its length has bits.
    """
    while True:
        further = single.select(F.col("v").alias("r"), F.col("r").alias("further"), F.col("flip").alias("again"))
        single = checkpointed(single.join(further, "r", "left").select("v", F.coalesce("further", "r").alias("r"), (F.col("flip") != F.coalesce("again", F.lit(False))).alias("flip"), F.col("further").isNotNull().alias("moved")))
        if single.where("moved").isEmpty():
            return single.select("v", "r", "flip")
        single = single.select("v", "r", "flip")


def first_independent(nodes: DataFrame, links: DataFrame, few: int = FEW) -> DataFrame:
    """(idx, leads) of the lexicographically first maximal independent set: a node leads unless an earlier neighbour does.

    ``links`` (i, j) with i < j. A round keeps, for each undecided node, what it hangs on: "i leads", or with ``turned`` "i
    does not lead". One that hangs on nothing leads, one on two things of which one must hold does not. One that
    hangs on a single thing is a function of that node; chains of these are followed at once (``_along``), and whoever
    hangs on such a node hangs on its chain's end from then on. As soon as few (``few``) are left, they are gone through
    one by one.
    """
    none = checkpointed(nodes.select("idx", F.lit(None).cast("boolean").alias("leads")).limit(0))
    live, parts = checkpointed(links.select(F.col("j").alias("v"), F.col("i").alias("r"), F.lit(False).alias("turned")).distinct()), [none]
    while True:
        decided = reduce(DataFrame.unionByName, parts)
        hangs = live.groupBy("v").agg(F.count("*").alias("things"), F.min("r").alias("r"), F.min("turned").alias("turned"))
        roots = live.select(F.col("r").alias("idx")).distinct().join(hangs.select(F.col("v").alias("idx")), "idx", "left_anti").join(decided, "idx", "left")
        rest = live.limit(few + 1).collect()
        if len(rest) <= few:
            known = {r.idx: r.leads is not False for r in roots.collect()}
            for v, r, turned in sorted(map(tuple, rest), key=lambda x: x[:2]):  # all that a node hangs on is decided before it
                known[v] = known.get(v, True) and known[r] == turned
            schema = T.StructType([T.StructField("idx", nodes.schema["idx"].dataType), T.StructField("leads", T.BooleanType())])
            last = nodes.sparkSession.createDataFrame([(v, known[v]) for v in {v for v, _, _ in rest}], schema)
            return nodes.select("idx").join(decided.unionByName(last), "idx", "left").select("idx", F.coalesce("leads", F.lit(True)).alias("leads"))
        roots = checkpointed(roots.select("idx", F.coalesce("leads", F.lit(True)).alias("leads"), F.col("leads").isNull().alias("new")))
        ends = _along(checkpointed(hangs.where("things = 1").select("v", "r", (~F.col("turned")).alias("flip"))))
        by_end = checkpointed(ends.join(roots.select(F.col("idx").alias("r"), "leads"), "r").select(F.col("v").alias("idx"), (F.col("leads") != F.col("flip")).alias("leads")))
        state = roots.select("idx", "leads").unionByName(by_end).select(F.col("idx").alias("r"), "leads")
        moved = ends.select(F.col("v").alias("r"), F.col("r").alias("end"), "flip")
        asked = live.join(by_end.select(F.col("idx").alias("v")), "v", "left_anti").join(state, "r", "left").join(moved, "r", "left")
        asked = checkpointed(asked.select("v", (F.col("leads") != F.col("turned")).alias("holds"), F.coalesce("end", "r").alias("r"), (F.col("turned") != F.coalesce("flip", F.lit(False))).alias("turned")))
        open_ = asked.where("holds is null").groupBy("v", "r").agg(F.min("turned").alias("turned"), (F.min("turned") != F.max("turned")).alias("torn"))
        told = asked.groupBy("v").agg(F.bool_or("holds").alias("holds"), F.count_if(F.col("holds").isNull()).alias("left"))
        told = told.join(open_.where("torn").select("v", "torn").distinct(), "v", "left")
        told = told.select(F.col("v").alias("idx"), F.when(F.coalesce("holds", F.lit(False)) | F.col("torn").isNotNull(), False).when(F.col("left") == 0, True).alias("leads"))
        told = checkpointed(told.where("leads is not null"))
        parts += [roots.where("new").select("idx", "leads"), by_end, told]
        live = checkpointed(open_.select("v", "r", "turned").join(told.select(F.col("idx").alias("v")), "v", "left_anti"))


def leaders(messages: DataFrame, threshold: float, few: int = FEW) -> DataFrame:
    """(idx, leader) by leader clustering in order of ``idx``: a message joins its first similar leader, else leads.

    Copies of a token set follow their first one, which is what going through them one by one gives too.
    """
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    coded = _coded(messages)
    members = checkpointed(_represented(coded.select("idx", "key")))
    edges = checkpointed(_pairs(coded, threshold).select("i", "j"))
    state = checkpointed(first_independent(members.select(F.col("rep").alias("idx")).distinct(), edges, few))
    lead = state.where("leads").select(F.col("idx").alias("i"))
    first = edges.join(lead, "i").groupBy(F.col("j").alias("idx")).agg(F.min("i").alias("first"))
    led = state.join(first, "idx", "left").select(F.col("idx").alias("rep"), F.when(F.col("leads"), F.col("idx")).otherwise(F.col("first")).alias("leader"))
    return members.join(checkpointed(led), "rep").select("idx", "leader")


def clusters_of(messages: DataFrame, membership: DataFrame, kind: str, least: int, least_contexts: int | None = None) -> DataFrame:
    """Clusters by ``membership`` (idx, leader); see ``clusters``. No texts are gathered: a leader is its cluster's first message."""
    rows = messages.select("idx", "context_id").join(membership, "idx")
    sized = rows.groupBy("leader").agg(F.count("*").alias("n"), F.countDistinct("context_id").alias("contexts"))
    sized = sized.where((F.col("n") >= least) & (F.col("contexts") >= (least_contexts or least)))
    first = messages.select(F.col("idx").alias("leader"), F.col("text").alias("representative"))
    out = sized.join(first, "leader").withColumn("kind", F.lit(kind))
    return out.select("kind", "leader", "representative", "n", "contexts", X.cluster_hash(F.col("representative"), F.col("kind")).alias("content_hash"))


def clusters(messages: DataFrame, kind: str, threshold: float, least: int, least_contexts: int | None = None) -> DataFrame:
    """Clusters of ``messages`` (idx, context_id, text, tokens) with at least ``least`` members from ``least_contexts`` sessions (as many by default).

    (kind, leader, representative, n, contexts, content_hash); who belongs to them is told by ``leaders``.
    """
    return clusters_of(messages, leaders(messages, threshold), kind, least, least_contexts)


def novel(found: DataFrame, known: DataFrame) -> DataFrame:
    """Clusters whose hash ``known`` (content_hash) does not hold."""
    return found.join(known.select("content_hash"), "content_hash", "left_anti")


def largest(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest clusters; of equals instructions first, then by leader."""
    return found.orderBy(F.desc("n"), F.when(F.col("kind") == INSTRUCTION, 0).otherwise(1), "leader").limit(most)


def contexts(found: DataFrame) -> DataFrame:
    """(context_id): the sessions of clusters with their ``occurrences``, each once."""
    return found.select(F.explode("occurrences.context_id").alias("context_id")).distinct()


def detect(messages: DataFrame, corrected: DataFrame, config: PatternConfig, known: DataFrame) -> DataFrame:
    """The pass's clusters: repeated instructions and repeated corrections that ``known`` does not hold, largest first.

    Both inputs: (idx, context_id, project, text), messages with their tokens.
    """
    corrected = corrected.withColumn("tokens", X.tokens(F.col("text")))
    said, again = (checkpointed(leaders(m, config.similarity_threshold)) for m in (messages, corrected))
    found = clusters_of(messages, said, INSTRUCTION, config.min_occurrences).unionByName(clusters_of(corrected, again, CORRECTION, max(config.min_occurrences, 2), 2))
    found = checkpointed(largest(novel(found, known), config.max_clusters_per_pass))
    # Messages are gathered for the clusters taken alone (at most max_clusters_per_pass rows): the pass's prompt is one text.
    taken = F.broadcast(found.select("kind", "leader"))
    rows = [m.select("idx", "context_id", "project", "text").join(of, "idx").withColumn("kind", F.lit(kind)).join(taken, ["kind", "leader"]) for m, of, kind in ((messages, said, INSTRUCTION), (corrected, again, CORRECTION))]
    listed = rows[0].unionByName(rows[1]).groupBy("kind", "leader").agg(F.array_sort(F.collect_list(F.struct("idx", "context_id", "project", "text"))).alias("occurrences"))
    return largest(found.join(listed, ["kind", "leader"]), config.max_clusters_per_pass)
