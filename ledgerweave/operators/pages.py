"""Page grouping and page merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The three forms of a page marker; total and page, page and total, page and total.
MARKER = r"共\s*(\d+)\s*页\s*第\s*(\d+)\s*页|第\s*(\d+)\s*页\s*/\s*(\d+)|第\s*(\d+)\s*页\s*共\s*(\d+)\s*页"


def group_pages(pages: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """Add group_id (0-based in a document): consecutive equal values form a group, a null is one of its own."""
    w = Window.partitionBy(doc).orderBy(order)
    before = F.lag(value).over(w)
    starts = F.when(F.col(value).isNull() | before.isNull() | (F.col(value) != before), 1).otherwise(0)
    return pages.withColumn("_starts", starts).withColumn("group_id", F.sum("_starts").over(w) - 1).drop("_starts")


def merge_pages(pages: DataFrame, keys: list[str], order: str, first: list[str], last: list[str], lists: list[str]) -> DataFrame:
    """One row per group: columns from its first or last page, and lists joined in page order."""
    return pages.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        *[F.max_by(c, order).alias(c) for c in last],
        *[F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])).alias(c) for c in lists],
        F.count(F.lit(1)).alias("n_pages"),
    )


#: The fields of a document that its last page gives; its first page gives the others (number, date, type, parties).
LAST_PAGE_KEYS = ("amountHj", "amountJe", "amountSe", "bz", "skr", "fhr", "kpr", "jym", "jshjdx", "jshjxx")
#: Fields that stand beside the map too, by their names there.
SYNCED_KEYS = {"number": "fphm", "type": "type", "date": "kprq"}


def merged_results(pages: DataFrame, keys: list[str], order: str = "page") -> DataFrame:
    """keys, number, type, date, amount, extra, line_items, page_count: the parse results of a document's pages as one.

    The amount and the fields in LAST_PAGE_KEYS come from the last page that ends the document, where it has them, all other fields from the first one; a field that only
    another page has is there without a value. Line items follow each other in page order. Of several pages the number, type and date are those of the merged fields
    where these are filled. ``pages``: keys, order, number, type, date, amount, extra (map), line_items (array).
    """
    named = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    rows = pages.withColumn("extra", named)
    items = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("line_items", F.array().cast(pages.schema["line_items"].dataType)).alias("v")))), lambda x: x["v"]))
    per = rows.groupBy(*keys).agg(
        F.min_by(F.struct("number", "type", "date", "extra"), order).alias("_first"), F.max_by(F.struct("amount", "extra"), order).alias("_last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("extra"))))).alias("_names"), items.alias("line_items"), F.count(F.lit(1)).alias("page_count"),
    )
    first, last = F.col("_first.extra"), F.col("_last.extra")
    from_last = lambda k: k.isin(*LAST_PAGE_KEYS) & F.map_contains_key(last, k)
    value = lambda k: F.when(from_last(k), F.try_element_at(last, k)).otherwise(F.try_element_at(first, k))
    per = per.withColumn("extra", F.map_from_entries(F.transform("_names", lambda k: F.struct(k.alias("key"), value(k).alias("value")))))
    several = F.col("page_count") > 1
    synced = [F.coalesce(F.when(several, F.nullif(F.try_element_at("extra", F.lit(k)), F.lit(""))), F.col(f"_first.{c}")).alias(c) for c, k in SYNCED_KEYS.items()]
    return per.select(*keys, *synced, F.col("_last.amount").alias("amount"), "extra", "line_items", "page_count")


def page_marker(text: Column) -> tuple[Column, Column]:
    """Page and total of the first marker in the text, null without one; a bare 1/3 is none, as it may be a date."""
    get = lambda i: F.nullif(F.regexp_extract(text, MARKER, i), F.lit(""))
    page = F.coalesce(get(2), get(3), get(5)).try_cast("int")
    total = F.coalesce(get(1), get(4), get(6)).try_cast("int")
    return page, total
