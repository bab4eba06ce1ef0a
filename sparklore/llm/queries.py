"""One registered query for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, hard_negatives, source_audit, warc
from .common import scratch_path, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import ids_crc32, read_token_orc, write_token_orc

    path = scratch_path(spark, "token_orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=1)
    return ids_crc32(read_token_orc(spark, path))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_token_orc": op2_token_orc, "op3_html_text": op3_html_text, "op4_simhash": op4_simhash, "op5_quality": op5_quality, "op6_toxicity": op6_toxicity, "op7_warc": op7_warc, "op8_embeddings": op8_embeddings, "op9_sentencepiece": op9_sentencepiece, "op10_url_filter": op10_url_filter, "op11_source_audit": op11_source_audit, "op12_token_counts": op12_token_counts, "op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL: dict[str, str] = {"op7_warc": warc.oracle_sql(), "op8_embeddings": embeddings.ORACLE, "op11_source_audit": source_audit.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
