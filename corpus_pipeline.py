"""From raw documents to token ids, in five stages, each over all that the one before kept.

All stages but the last return the columns they are given, whatever their names. Null texts are judged as empty
ones, rows that repeat are judged each alike but for near-duplicates, which keep one of them; null ids are
larger than any other. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklore.llm import decontaminate, pieces, quality, simhash, toxicity
from sparklore.llm.common import stored, table
from sparklore.llm.queries import _tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more, null and empty texts by their score too.

    All of them where no document is labelled good, as there is nothing to learn from.
    """
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.3; null and wordless texts score 0. All where labels are of one kind."""
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked (4 bits or fewer), the one of the smallest id.

    Null and wordless texts have fingerprint 0 and are one group; of rows that repeat the smallest id one stays.
    """
    return simhash.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose whole text no benchmark item occurs within the edit budget; null texts hold none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): SentencePiece ids, and whether they decode to the text; null and empty texts have no ids."""
    return pieces.round_trip(docs, _tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark),
    ("sentencepiece", token_ids),
]

#: The trained stages cannot be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
