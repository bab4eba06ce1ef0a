"""Operator 9: SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (a leading space, spaces as U+2581) and cut before each run of marks, and between letters
and those other characters that no piece of the vocabulary has next to a letter. No piece reaches over such
a cut, so a text's ids are its marked words' ids one after the other. The distinct marked words of a batch
are sorted, which lays them out as a trie, and traversed depth-first: the forward states of the prefix that
a word shares with the one before are kept, only the rest is computed.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). In a BPE model
pieces are not chosen by the sum of their scores but by merge rank; there the state is the last piece of
the prefix's own encoding: the one piece that ends there and stays next to the last piece of what precedes
it when both are merged afresh. That choice is unique and gives exactly the merge order's result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, slices, small_batches, worker_state

MARK = "▁"
#: Key of a vocabulary node's own piece; no character.
PIECE = ""
#: Words that a worker remembers (see ``Remembered``), and pairs of pieces, which it forgets at the bound.
REMEMBERED, PAIRS = 250_000, 250_000
#: Letters, in a regular expression: digits, underscores and superscripts are none.
LETTER = r"[^\W\d_²³¹]"


def word_cutter(pieces):
    """A function from a marked text to its words, such that no piece of ``pieces`` reaches over a cut.

    Words are runs of marks with what follows; parted from those are runs of ASCII characters besides letters
    that no piece has next to a letter, where they stand between letters, marks or the text's ends.
    """
    letter, apart = re.compile(LETTER).match, {chr(c) for c in range(128) if not chr(c).isalpha()}
    for piece in pieces:
        if not apart.isdisjoint(piece):
            apart.difference_update(x if letter(y) else y for x, y in zip(piece, piece[1:]) if bool(letter(x)) != bool(letter(y)))
    other = "[" + "".join(map(re.escape, sorted(apart))) + "]" if apart else "(?!)"
    return re.compile(rf"{MARK}*{LETTER}++(?={other}|{MARK}|\Z)|{other}++(?={LETTER}|{MARK}|\Z)|{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class Pieces:
    """A vocabulary: piece texts with scores, byte pieces, and the forward pass over sorted words."""

    def __init__(self, texts: dict[str, tuple[int, float]], bytes_: list[int], unknown: int, bpe: bool, names: list[bytes]):
        self.texts, self.bytes, self.unknown, self.bpe, self.names = texts, bytes_, unknown, bpe, names
        self.trie: dict = {}
        for text, (_, score) in texts.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[PIECE] = text, score
        self.least = min((s for _, s in texts.values()), default=0.0) - 10.0
        self.blobs = {t: i.to_bytes(4, "little") for t, (i, _) in texts.items()}
        self.cut, self.words = word_cutter(texts), Remembered(REMEMBERED)
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str, bpe: bool = True) -> Pieces:
        texts, names, bytes_, unknown = _vocabulary(path)
        return cls(texts, bytes_, unknown, bpe, names)

    def merged(self, text: str) -> list[str]:
        """``text`` by merging, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                known = self.texts.get(parts[i] + parts[i + 1])
                if known and (best is None or known[1] > best[0]):
                    best = known[1], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stays(self, left: str, piece: str) -> bool:
        """Whether ``piece`` is left as it is beside ``left`` (no piece, where none precedes or it is unknown)."""
        known = left if left in self.texts else ""
        out = self.pairs[left, piece] = self.merged(known + piece) == ([known, piece] if known else [piece])
        return out

    def _forward(self, words: list[str]):
        """(word, its pieces) for sorted ``words``; lists hold one state a prefix of the current path.

        ``open_`` has, for a prefix, where a piece may have begun and the vocabulary node reached since,
        the longest first.
        """
        last, scores, open_, path, root, stays = [""], [0.0], [[]], "", self.trie, self.pairs
        for word in words:
            keep, most = 0, min(len(path), len(word))
            while keep < most and path[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], scores[keep + 1 :], open_[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                c = word[end - 1]
                begun = [(start, after) for start, node in open_[-1] if (after := node.get(c)) is not None]
                if (after := root.get(c)) is not None:
                    begun.append((end - 1, after))
                open_.append(begun)
                piece, score = c, None
                for start, node in begun:
                    known = node.get(PIECE)
                    if known is None:
                        continue
                    if not self.bpe:
                        if score is None or scores[start] + known[1] > score:
                            piece, score = known[0], scores[start] + known[1]
                        continue
                    key = last[start], known[0]
                    fits = stays.get(key)
                    if self._stays(*key) if fits is None else fits:
                        piece = known[0]
                        break
                last.append(piece)
                if not self.bpe:
                    scores.append(score if score is not None else scores[end - 1] + self.least)
            path, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield word, out[::-1]

    def _ids(self, unknown: str) -> bytes:
        """The ids of a character that is no piece: its bytes', or the unknown piece's."""
        ids = [self.bytes[b] for b in unknown.encode()] if any(self.bytes) else [self.unknown]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        return [blob for some in slices(texts) for blob in self._some(some)]

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        cut, found = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts], set()
        for words in cut:
            found.update(words)
        new, blobs, known = sorted(self.words.missing(found)), self.blobs, self.words.recent
        for word, pieces in self._forward(new):
            known[word] = b"".join([blobs.get(p) or self._ids(p) for p in pieces])
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, ids) -> str:
        return decoded(self.names, self.unknown, ids)


def _vocabulary(path: str) -> tuple[dict[str, tuple[int, float]], list[bytes], list[int], int]:
    """Ids and scores of the model's pieces, the bytes each id stands for, the ids of bytes, and the unknown piece's."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, names, bytes_ = {}, [], [0] * 256
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            names.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i):
            names.append(b"")
        elif m.is_unknown(i):
            names.append(" ⁇ ".encode())
        else:
            texts[piece] = i, m.get_score(i)
            names.append(piece.replace(MARK, " ").encode())
    return texts, names, bytes_, m.unk_id()


def decoded(names: list[bytes], unknown: int, ids) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
    n = len(names)
    known = [i for i in ids if 0 <= i < n and names[i]]
    text = b"".join([names[i] for i in known]).decode("utf-8", "replace")
    return text.removeprefix(" ") if known and known[0] != unknown else text


def _pieces(path: str, bpe: bool) -> Pieces:
    return worker_state(("pieces", path, bpe), lambda: Pieces.load(path, bpe))


def _as_lists(blobs: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", name: str = "ids", bpe: bool = True) -> DataFrame:
    """``docs`` with ``name`` (array<int>, replaced if there), the ids of the whole text; null and empty texts have none."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches):
        pieces = _pieces(model_path, bpe)
        for batch in batches:
            blobs = pieces.encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _as_lists(blobs)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with ``name`` (replaced if there), the text of ``ids_col``; null ids give null, empty ones an empty text."""
    rows = rows.drop(name)
    at, schema = rows.columns.index(ids_col), T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        _, names, _, unknown = worker_state(("names", model_path), lambda: (None, *_vocabulary(model_path)[1:]))
        for batch in batches:
            texts = [None if ids is None else decoded(names, unknown, ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, exact): every text's ids, and whether decoding them gives the text again.

    Null texts count as empty. A text that itself holds U+2581 decodes to a space in its place, so it is
    not exact. Rows that repeat are encoded each; other columns are ignored; empty in, empty out.
    """
    small_batches(docs.sparkSession, 1000, 4 << 20)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        # One worker does both ways: two chained ones would each hold the vocabulary.
        pieces = _pieces(model_path, True)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            blobs = pieces.encode(texts)
            exact = [pieces.decode(np.frombuffer(b, "<u4").tolist()) == t for b, t in zip(blobs, texts)]
            sizes = pa.array([len(b) // 4 for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_lists(blobs), sizes, pa.array(exact, pa.bool_())], names=[id_col, "ids", "n_tokens", "exact"])

    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    return rows.mapInArrow(run, schema)
