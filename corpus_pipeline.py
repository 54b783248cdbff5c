"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokenizing.

Every stage takes the documents its predecessor kept and returns documents again; the last returns tokens.

Cases, in every stage: an empty table gives an empty one with the same columns; rows without an id, or with the id of another row, are rows like any
others; nulls in lang, source and n_chars pass through; extra columns are dropped. Quality rules reject null and empty texts, as they have under 50
words; the stages after it take them as texts without words: line dedup leaves them, each is a group of its own in the near-dedup stage, the mix never takes
them, as they weigh nothing, and their tokens are the end id alone. Ties: of equal lines and passages the row with the smallest id, then hash of its text, keeps its copy; of a near-duplicate
group the smallest id stays, null last, then the first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import line_dedup, mixing, near_dedup, piece_merges, quality_rules
from ledgerweave.llm.queries import model_path
from ledgerweave.session import durable, temporary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated three-line windows; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, null last.

    Rows get a written key of their own, so repeated rows, rows with one id and rows without an id are compared like any others.
    """
    rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*COLUMNS).alias("doc")))
    found = near_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"))
    id_of = rows.select("row", F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.col("row")).alias("rank"))
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(id_of, "row")
    stays = groups.groupBy("component_id").agg(F.min_by("row", "rank").alias("row")).select("row")
    return rows.join(stays, "row", "left_semi").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return piece_merges.tokenize(docs, model_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("mixing", mixed), ("tokens", tokens)]

#: The cascade's extra rules use look-around and MinHash has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with temporary():
            docs = durable(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
