"""Search, ordering and paging of records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.dates import UNKNOWN
from ledgerweave.functions.money import leading_number
from ledgerweave.functions.text import natural_key

ORDER_FIELDS = ("date", "amount", "created_at", "file_name")


@dataclass(frozen=True)
class SearchSpec:
    keyword: str = ""
    type: str = ""
    date_from: str = ""
    date_to: str = ""
    order_by: str = "created_at"
    order_dir: str = "DESC"
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        if self.offset < 0:
            raise ValueError("offset must not be negative")


def live(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("deleted_at", F.lit("")) == "")


def matching(records: DataFrame, spec: SearchSpec) -> DataFrame:
    """Live rows that fit keyword (in search_text), type and the inclusive date range, compared as texts."""
    df = live(records)
    if spec.type:
        df = df.where(F.col("type") == spec.type)
    day = F.coalesce("date", F.lit(""))
    if spec.date_from:
        df = df.where(day >= spec.date_from)
    if spec.date_to:
        df = df.where(day <= spec.date_to)
    if spec.keyword:
        df = df.where(F.contains("search_text", F.lit(spec.keyword.lower())))
    return df


def search(records: DataFrame, spec: SearchSpec) -> tuple[DataFrame, DataFrame]:
    """The page's rows and a one-row total. Ties keep the order of ``pos``, whatever the direction."""
    field = spec.order_by if spec.order_by in ORDER_FIELDS else "created_at"
    key = F.coalesce(F.col(field).try_cast("double"), F.lit(0.0)) if field == "amount" else F.coalesce(F.col(field).cast("string"), F.lit(""))
    found = matching(records, spec)
    order = key.asc() if spec.order_dir.upper() == "ASC" else key.desc()
    page = found.orderBy(order, F.col("pos").asc()).offset(spec.offset).limit(min(max(spec.limit, 1), 1000))
    return page, found.agg(F.count(F.lit(1)).alias("total"))


def listed(records: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Live rows in store order; without a positive limit all rows, the offset then does not count."""
    rows = live(records).orderBy("pos")
    return rows.offset(offset).limit(limit) if limit and limit > 0 else rows


def is_incomplete(failed_fields: Column, method: Column) -> Column:
    """What bulk removal takes: as ``is_failed``, whatever the status."""
    return F.coalesce(F.size(failed_fields) > 0, F.lit(False)) | F.coalesce(F.contains(method, F.lit("缺失")), F.lit(False))


def is_failed(status: Column, failed_fields: Column, method: Column) -> Column:
    return F.coalesce(status == "error", F.lit(False)) | is_incomplete(failed_fields, method)


def partition_of(failed: Column, duplicate_group: Column, previous_year: Column) -> Column:
    """0 failed, 1 duplicate, 2 previous year, 3 other."""
    return F.when(failed, 0).when(duplicate_group.isNotNull(), 1).when(previous_year, 2).otherwise(3)


def list_order(field: str, descending: bool) -> list[Column]:
    """Sort keys within a partition of the list; missing amounts and dates come last both ways, names break ties."""
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    name = natural_key(F.col("name"))
    if field == "invoiceType":
        keys = [turn(F.when(F.col("type") == "专票", 0).when(F.col("type") == "普票", 1).otherwise(2))]
    elif field == "fileName":
        keys = [turn(name)]
    elif field == "amount":
        keys = [turn(leading_number(F.col("amount").cast("string")))]
    elif field == "invoiceDate":
        keys = [turn(F.nullif(F.nullif(F.col("date"), F.lit(UNKNOWN)), F.lit("")))]
    else:
        keys = []
    return [*keys, name.asc()]


def sort_list(files: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Files with failed, duplicate_group, previous_year in display order, ties by pos."""
    part = partition_of(F.col("failed"), F.col("duplicate_group"), F.col("previous_year"))
    group = F.when(part == 1, F.col("duplicate_group"))
    return files.withColumn("partition", part).orderBy("partition", group.asc_nulls_first(), *list_order(field, descending), "pos")


def client_found(files: DataFrame, query: str | None) -> DataFrame:
    """Files (search_text, name) that hold the query, whatever its case and the blanks around it; all without one. A file without a text is found by its name."""
    wanted = (query or "").strip().lower()
    text = F.coalesce(F.nullif("search_text", F.lit("")), F.lower("name"))
    return files.where(F.contains(text, F.lit(wanted))) if wanted else files
