"""Adapter from the driver's star schema to invoice-shaped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoice records; amounts are exact to the cent."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("number"),
        F.col("o_orderpriority").alias("type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_orderstatus") != "P").cast("int").alias("parse_ok"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("custkey"),
    )
