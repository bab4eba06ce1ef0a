"""Operator 2: token ids as ORC with integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned by id, encoded, and written so that file k holds smaller ids than
file k + 1 and each file is sorted. ``ids`` is an ``array<int>`` column, which ORC stores with its
integer run-length encoding; the row index (min/max per stride) and the Bloom filter on the id let a
reader skip stripes and strides, and Spark reads stripes in parallel.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, slices, small_batches, worker_state

#: Text chunks that a worker remembers (see ``Remembered``).
CACHED = 250_000
SENTINEL = "\x01"
#: Precomposed Latin letters, each one letter in lower case too.
LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
LETTERS = re.compile(LETTER + "+").fullmatch
#: Full stops and commas between such a letter and a space or the end, which are a token of their own there.
STOPS = (rf"({LETTER})([.,]+)( |$)", r"\1 \2\3")
#: How a tokenizer file must part texts for ``ChunkEncoder`` to take them apart at spaces and line ends.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def parts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer of file ``spec`` is lower-casing BPE with word ends that no token reaches over a space in."""
    steps, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], spec["model"]
    added = spec.get("added_tokens") or []
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == (PARTS, "Removed", True)
        and not steps[1].get("add_prefix_space")
        and (model["type"], model.get("end_of_word_suffix")) == ("BPE", "</w>")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in added)
    )


class ChunkEncoder:
    """Encodes texts by the distinct chunks that stand between spaces and line ends.

    The tokenizer parts texts at white space, so a text's ids are its chunks' ids one after the other. Trailing
    full stops and commas are chunks too, and A-Z are put in lower case first, so that fewer chunks differ.
    New chunks of letters go to the library many at a time (without the normaliser, which leaves them as they
    are), parted again where a token ends a word; other new chunks are parted by a control character that is
    one token. A tokenizer of another kind (see ``parts_at_spaces``) gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark = self._ids([SENTINEL])[0]
        self.by_chunks = parts_at_spaces(spec) and len(mark) == 1
        if not self.by_chunks:
            return
        (self.mark,) = mark
        spaced = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.of_letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": spaced}}))
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known = Remembered(CACHED)
        #: Texts with a mark that may join a letter, or with what may be a special token, keep their capitals.
        self.cased = r"\pM|" + "|".join(re.escape(t["content"][:2]) for t in spec.get("added_tokens") or [{"content": SENTINEL}])

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, names: list[str], sep: str, ends, past: int, into: dict[str, bytes], tokenizer=None) -> None:
        """Encode ``names`` joined by ``sep``; ``ends(ids)`` has where each one's ids stop."""
        groups = [names[i : i + 512] for i in range(0, len(names), 512)]
        for group, ids in zip(groups, self._ids([sep.join(g).lower() if tokenizer else sep.join(g) for g in groups], tokenizer)):
            flat = np.array(ids, dtype="<u4")
            stops, data, at = ends(flat), flat.tobytes(), 0
            for name, stop in zip(group, stops, strict=True):
                into[name] = data[4 * at : 4 * stop]
                at = stop + past

    def learn(self, chunks: set[str]) -> None:
        """Make ``known.recent`` have all of ``chunks``."""
        words, odd, known = [], [], self.known.recent
        for c in chunks:
            if LETTERS(c):
                words.append(c)
            elif SENTINEL in c:
                known[c] = np.array(self._ids([c])[0], dtype="<u4").tobytes()
            else:
                odd.append(c)
        words.sort()
        self._cut(words, " ", lambda ids: (np.flatnonzero(self.closes[ids]) + 1).tolist(), 0, known, self.of_letters)
        self._cut(odd, f" {SENTINEL} ", lambda ids: [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], 1, known)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all their ids in turn (unsigned 32-bit)."""
        counts, ids = zip(*(self._some(s) for s in slices(texts))) if texts else ((), ())
        return np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, "<u4"), *ids])

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunks:
            whole = [np.array(i, dtype="<u4") for i in self._ids(texts)]
            return np.array([len(i) for i in whole], np.int64), np.concatenate(whole)
        spaced = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        if not pc.any(pc.match_substring_regex(spaced, self.cased)).as_py():
            spaced = pc.ascii_lower(spaced)
        lists = pc.split_pattern(pc.replace_substring_regex(spaced, *STOPS), " ")
        chunks = lists.flatten().dictionary_encode()
        which, names = chunks.indices.to_numpy(), chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(self.known.missing(set(names)))
        known = self.known.recent
        blobs = [known[c] for c in names]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        data, begins, held = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(sizes) - sizes, sizes[which]
        ends = np.cumsum(held)
        ids = data[np.repeat(begins[which] - (ends - held), held) + np.arange(ends[-1])]
        at = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return np.diff(at), ids


def _encoder(path: str) -> ChunkEncoder:
    return worker_state(("chunks", path), lambda: ChunkEncoder(path))


def encode_column(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of (id_col, ids, n_tokens, part, local_start) in the order they have within each partition."""

    def run(batches):
        encoder, start, part = _encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            counts, found = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            lengths = counts + 1
            ends, n = np.cumsum(lengths), len(lengths)
            values = pa.array(np.insert(found, np.cumsum(counts), end_id).view("<i4"))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(lengths), pa.array(np.full(n, part, np.int32)), pa.array(start + ends - lengths)],
                names=[id_col, "ids", "n_tokens", "part", "local_start"],
            )
            start += int(lengths.sum())

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, part int, local_start long")


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
    index_stride: int = 1000,
    partitions: int | None = None,
) -> None:
    """Encode ``docs`` and write their ids under ``path`` in ascending id order.

    Null and empty texts are the end id alone. Null ids come first. Rows that repeat an id keep their
    own entries, in text order. Further columns are not written. Bounded: a task holds one Arrow batch
    of texts, the sort spills. ``partitions`` defaults to the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000, 4 << 20)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(id_col, text_col).repartitionByRange(n, F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    rows = encode_column(dealt.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)), tokenizer_path, end_id, id_col, text_col)
    (
        rows.write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of ``path``: id, ids, n_tokens and ``start``, the number of ids of all documents before.

    A filter on the id is pushed to stripes and strides. Starts come from one total per written part
    (a row per part, so a table of bounded size) and the offsets stored within each part.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").select(id_col, (F.col("before") + F.col("local_start")).alias("start"), "ids", "n_tokens")


def ids_crc32(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): counts and checksums of the ids as read."""

    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, int)
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<u4").tobytes())
            o = (offsets * 4).tolist()
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "start", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
