"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import (
    chat_format, line_dedup, media, mixing, near_dedup, phrases, piece_merges, quality_rules, secret_scan, substring_dedup, token_alignment,
    url_filter, warc,
)

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ``rejected_by``, which depends on measured times, so that reruns agree."""
    judged = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "rejected_by")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_query(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op4_query(_read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=80)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op6_query(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents stand for the pages of the same number: low quality or toxic is bad."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op8_query(_read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_merges.tokenize(_read(spark, sf_dir, "documents"), model_path(), digests=True)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op10_query(_read(spark, sf_dir, "conversations"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op11_query(_read(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = token_alignment.byte_level(model_path("byte_bpe_50k.json")), token_alignment.piece_level(model_path())
    return token_alignment.align(_read(spark, sf_dir, "documents"), a, b)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = (
        op1_quality_rules, op2_secret_scan, op3_mix_sources, op4_substring_dedup, op5_near_dedup, op6_media,
        op7_url_filter, op8_line_dedup, op9_sentencepiece, op10_chat_format, op11_warc, op12_token_alignment,
        op13_phrases,
    )
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op13_phrases": phrases.ORACLE_SQL}
