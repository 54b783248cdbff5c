"""Statistics, duplicates, totals and document views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.session import durable


def exact(x: Column) -> Column:
    return F.coalesce(x.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def statistics(records: DataFrame) -> DataFrame:
    """One row per type, and in total: n, total, ok, failed; by grouping sets in one pass (type null and grand true)."""
    return records.rollup("type").agg(
        F.grouping("type").cast("boolean").alias("grand"),
        F.count(F.lit(1)).alias("n"),
        F.sum(exact(F.col("amount"))).alias("total"),
        F.sum(F.when(F.col("parse_ok") == 1, 1).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("parse_ok") == 1, 0).otherwise(1)).alias("failed"),
    )


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Add 1, 2, 3 and so on by ``order``, whose values differ: ranges are numbered on their own and start after the rows before them.

    The ranges are written, so that their bounds stay if an executor is lost. Only the window over one row per range is in one task.
    """
    ranges = durable(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))
    own = ranges.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return own.join(starts, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Parsed files that share a non-empty number: group_index (by first appearance), is_first, total.

    Group indexes come from one row per group; files are only joined with them.
    """
    parsed = files.where((F.col("status") == "parsed") & (F.coalesce("number", F.lit("")) != ""))
    groups = parsed.groupBy("number").agg(F.count(F.lit(1)).alias("total"), F.min("pos").alias("first_pos")).where("total > 1")
    groups = numbered(groups, "first_pos", "group_index")
    return parsed.join(groups, "number").withColumn("is_first", F.col("pos") == F.col("first_pos"))


def identity(record_id: Column, file_name: Column, number: Column, pos: Column) -> Column:
    return F.coalesce(F.nullif(record_id, F.lit("")), F.nullif(file_name, F.lit("")), F.nullif(number, F.lit("")), F.concat(F.lit("__ANON_"), pos.cast("string")))


def export_totals(rows: DataFrame, header: dict[str, str], line: dict[str, str], key: str = "identity", pos: str = "pos") -> DataFrame:
    """One row: header columns counted once per identity (its first row), line columns on every row.

    Two partial aggregations, no window: the first row of an identity is min_by over its position.
    """
    per = rows.groupBy(key).agg(
        *[F.min_by(exact(F.col(c)), F.col(pos)).alias(a) for a, c in header.items()],
        *[F.sum(exact(F.col(c))).alias(a) for a, c in line.items()],
    )
    return per.agg(F.count(F.lit(1)).alias("n_invoices"), *[F.sum(a).alias(a) for a in (*header, *line)])


def serial_numbers(rows: DataFrame, key: str = "identity", pos: str = "pos") -> DataFrame:
    """Number the identities by first appearance; lines share their invoice's number."""
    first = rows.groupBy(key).agg(F.min(pos).alias("_first"))
    first = numbered(first, "_first", "serial").drop("_first")
    return rows.join(first, key)


def document_view(pages: DataFrame) -> DataFrame:
    """Pages (doc, instance, page_num, amount, failed, previous_year) to documents, then one summary row.

    A document's amount is that of its lowest page; of equal page numbers the lower amount counts, null last.
    """
    docs = pages.groupBy("doc", "instance").agg(
        F.min_by("amount", F.struct(F.coalesce("page_num", F.lit(1)), F.col("amount").isNull(), F.col("amount"))).alias("amount"), F.max("failed").alias("failed"), F.max("previous_year").alias("previous_year")
    )
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(exact(F.col("amount"))).alias("amount"),
        F.sum(F.col("failed").cast("long")).alias("failed"),
        F.sum(F.col("previous_year").cast("long")).alias("previous_year"),
    )


def progress(jobs: DataFrame) -> DataFrame:
    """Per batch: success, failed, and floor of the percentage done (0 for an empty batch)."""
    done = F.col("status").isin("success", "failed", "cancelled")
    agg = jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).alias("success"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
        F.sum(done.cast("int")).alias("done"),
    )
    return agg.withColumn("percent", F.coalesce(F.floor(F.try_divide(F.col("done") * 100, F.col("total"))), F.lit(0)))
