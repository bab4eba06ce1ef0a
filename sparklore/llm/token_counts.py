"""Operator 12: token counts with a whole-token shortcut.

A text is marked and cut into pre-tokens as operator 9 does it: no piece of the vocabulary reaches over a cut, so
a text's count is the sum of its pre-tokens' counts. Which strings of the vocabulary are one token when they
stand alone is proved once for a model, by encoding every one of them; a pre-token that is such a string counts
one without any merging. Only the others are merged, by the library, and each distinct one once while a worker
remembers it.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, slices, small_batches, worker_state
from .pieces import MARK, word_cutter

#: Pre-tokens that a worker remembers (see ``Remembered``), and the characters of one that is remembered at most.
REMEMBERED, LONGEST = 400_000, 200
LIMIT = 4096


class WholeTokens:
    """A model's proved strings and the counts of texts by them; models that cannot be cut so are asked for whole texts."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        held = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        ordinary = [p.piece for p in model.pieces if p.type == p.NORMAL]
        letters = set().union(*ordinary)
        # Stands before a string so that the library's own leading mark does not: it joins no piece.
        self.guard = next((c for c in map(chr, range(1, 32)) if c not in letters), None)
        self.cuts = bool(
            self.guard and held.add_dummy_prefix and held.escape_whitespaces and not held.remove_extra_whitespaces and not held.precompiled_charsmap
            and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
            and kinds.isdisjoint({model.SentencePiece.USER_DEFINED, model.SentencePiece.UNUSED}) and not any(MARK in p.lstrip(MARK) for p in ordinary)
        )
        self.proved: frozenset[str] = frozenset()
        self.words = Remembered(REMEMBERED)
        if self.cuts:
            self.cut = word_cutter(ordinary)
            self.before = len(self.library.encode(self.guard))
            self.proved = frozenset(s for s, n in zip(ordinary, self.merged(ordinary)) if n == 1)

    def merged(self, strings: list[str]) -> list[int]:
        """The tokens of each string where it stands alone, by the library."""
        return [len(ids) - self.before for ids in self.library.encode([self.guard + s for s in strings], num_threads=1)]

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(tokens, tokens that the shortcut counted) of every text."""
        if not self.cuts:
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)], [0] * len(texts)
        tokens, whole = [], []
        for part in slices(texts):
            words = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in part]
            new = self.words.missing(set().union(*words))
            rest = list(new - self.proved)
            known = self.words.recent
            known.update(dict.fromkeys(new & self.proved, 1))
            for some in slices(rest):
                known.update(zip(some, self.merged(some)))
            tokens += [sum(map(known.__getitem__, w)) for w in words]
            whole += [sum(map(self.proved.__contains__, w)) for w in words]
            for w in rest:
                if len(w) > LONGEST:
                    del known[w]
        return tokens, whole


@cache
def proved_strings(model_path: str) -> frozenset[str]:
    """The vocabulary strings that are one token when they stand alone; none for a model whose texts cannot be cut."""
    return WholeTokens(model_path).proved


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_whole) of every row's whole text, as the library counts it by default.

    ``n_whole`` of the tokens are pre-tokens that the shortcut counted. Null texts count as empty ones, with no
    tokens; special strings in a text are ordinary text. Rows that repeat are counted each, null ids are kept;
    columns besides the two are ignored; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches):
        model = worker_state(("whole", model_path), lambda: WholeTokens(model_path))
        for batch in batches:
            tokens, whole = model.count([t or "" for t in batch.column(1).to_pylist()])
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), over, pa.array(whole, pa.int64())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)])
    for name, kind in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("n_whole", T.LongType())):
        schema.add(name, kind)
    return rows.mapInArrow(run, schema)
