"""Records: lookups, whitelisted updates, shaping for export, checks, and facts about pages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.dates import UNKNOWN
from ledgerweave.functions.money import safe_float
from ledgerweave.functions.text import name_segment, sheet_name

#: Fields that an update may set.
UPDATABLE = (
    "category", "tags", "memo", "type", "amount", "date", "buyer", "seller", "buyer_tax", "seller_tax", "note",
    "issuer", "payee", "reviewer", "tax_amount", "file_name",
)
#: Defaults that stand for "not found", by field.
NOT_FOUND = {"type": "其他", "number": "未知号码", "amount": "0.00", "date": "未知日期"}
#: Keys of an export field, the first filled one counts.
ALIASES = {
    "invoiceType": ("type", "invoiceType"), "invoiceNumber": ("fphm", "invoiceNumber"), "invoiceDate": ("kprq", "invoiceDate"),
    "buyerName": ("gmfmc", "buyerName"), "buyerTaxNo": ("gmfsh", "buyerTaxNo", "buyerTaxId"), "sellerName": ("xsfmc", "sellerName"),
    "sellerTaxNo": ("xsfsh", "sellerTaxNo", "sellerTaxId"), "issuer": ("kpr", "issuer"), "note": ("note",), "xmmc": ("xmmc",),
}
AMOUNT_ALIASES = {
    "amountWithoutTax": ("amountJe", "amountWithoutTax"), "taxAmount": ("amountSe", "taxAmount"), "totalAmount": ("amountHj", "amount", "totalAmount"),
}


def allowed_updates(fields: Column) -> Column:
    """The entries of a map of fields that an update may set."""
    return F.map_filter(fields, lambda k, _: k.isin(*UPDATABLE))


def updated(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Live records (id, data map, deleted_at) with the allowed fields of their updates (id, fields) set; others stay as they are."""
    new = updates.select("id", allowed_updates(F.col("fields")).alias("_new"))
    joined = records.join(new, "id", "left")
    live = F.coalesce(F.col("deleted_at"), F.lit("")) == ""
    kept = F.map_filter("data", lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return joined.withColumn("data", F.when(live & F.col("_new").isNotNull(), F.map_concat(kept, F.col("_new"))).otherwise(F.col("data"))).drop("_new")


def duplicates_of(records: DataFrame, number: str) -> DataFrame:
    """Live records with a number, newest first; none for an empty number."""
    live = F.coalesce(F.col("deleted_at"), F.lit("")) == ""
    found = records.where(live & (F.col("number") == number) & (F.lit(number) != ""))
    return found.select("id", "file_name", "amount", "date", "created_at").orderBy(F.desc("created_at"), "id")


def exported(fields: Column) -> list[Column]:
    """Export columns of a map of texts: the first filled key of each field; amounts as numbers, 0 where they are none."""
    value = lambda keys: F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])
    return [
        *[F.coalesce(value(keys), F.lit("")).alias(name) for name, keys in ALIASES.items()],
        *[F.coalesce(value(keys).try_cast("double"), F.lit(0.0)).alias(name) for name, keys in AMOUNT_ALIASES.items()],
    ]


def net_amount(total: Column, tax: Column) -> Column:
    """Total less tax to the cent; what is no number counts as 0."""
    number = lambda x: F.coalesce(x.try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    return F.bround(number(total) - number(tax), 2).cast("double")


def overridden(found: Column, before: Column, field: str) -> Column:
    """What an extractor found replaces the parser's value unless it is empty or the field's default."""
    return F.when((F.coalesce(found, F.lit("")) != "") & (found != NOT_FOUND[field]), found).otherwise(before)


def response(fields: dict[str, Column], raw_text: Column, items: Column, boxes: Column, file_name: Column, batch: bool = False) -> Column:
    """Struct of a parse result: number, amount, date and type of ``fields``, those missing as failed, a new name, and bounded extras.

    At most 50 items, 200 boxes and 2000 characters of text are shown, as it is a view of one record; a batch shows no text.
    """
    number = F.when(F.coalesce(fields["number"], F.lit("")).isin("", "未知号码"), F.lit("")).otherwise(fields["number"])
    amount, date, kind = (F.coalesce(fields[f], F.lit("")) for f in ("amount", "date", "type"))
    failed = F.array_compact(F.array(F.when(number == "", "invoiceNumber"), F.when(amount == "", "amount"), F.when(date == "", "invoiceDate")))
    ext = F.when(F.contains(file_name, F.lit(".")), F.concat(F.lit("."), F.substring_index(file_name, ".", -1))).otherwise(".pdf")
    shown = lambda value, other: F.coalesce(F.nullif(value, F.lit("")), F.lit(other))
    parts = [name_segment(c) for c in (kind, shown(number, "未知"), shown(amount, "0"))]
    return F.struct(
        kind.alias("invoice_type"), number.alias("invoice_number"), amount.alias("amount"), date.alias("invoice_date"), failed.alias("failed_fields"),
        F.concat(F.concat_ws("_", *parts), ext).alias("new_name"), (F.lit("") if batch else F.left(F.coalesce(raw_text, F.lit("")), F.lit(2000))).alias("raw_text"),
        F.slice(F.coalesce(items, F.array()), 1, 50).alias("line_items"), F.slice(F.coalesce(boxes, F.array()), 1, 200).alias("bbox_data"),
    )


def is_structured(kind: Column, number: Column, amount: Column) -> Column:
    """At least two of: a real type, a number of 8, 10, 12 or 20 digits, an amount over 0."""
    digits = F.length(F.regexp_replace(number, r"\D", ""))
    value = F.regexp_replace(amount, "[,¥]", "").try_cast("double")
    tests = ((kind != "") & (kind != "其他"), (number != "未知号码") & digits.isin(8, 10, 12, 20), value > 0)
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) >= 2


#: Columns of a record and the fields of the parse result they come from.
RECORD_FIELDS = {"buyer": "gmfmc", "buyer_tax": "gmfsh", "seller": "xsfmc", "seller_tax": "xsfsh", "note": "note", "issuer": "kpr", "payee": "skr", "reviewer": "fhr"}
RAW_TEXT = 5000


def built(results: DataFrame) -> DataFrame:
    """Records of parse results: missing texts become empty, amounts numbers, an unknown date empty, raw texts are cut to RAW_TEXT characters.

    ``results``: hash_sha256, file_name, file_format, file_size, type, number, amount, date (texts), extra (map), line_items, parse_method, raw_text.
    """
    field = lambda k: F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit(""))
    date = F.coalesce(F.when(F.col("date") != UNKNOWN, F.col("date")), F.lit(""))
    return results.select(
        "hash_sha256", "file_name", "file_format", "file_size", "type", "number", safe_float(F.col("amount")).alias("amount"), date.alias("date"),
        *[field(k).alias(c) for c, k in RECORD_FIELDS.items()], safe_float(F.try_element_at("extra", F.lit("amountSe"))).alias("tax_amount"), "parse_method",
        is_structured(F.col("type"), F.col("number"), F.col("amount")).cast("int").alias("parse_ok"), F.coalesce(F.left("raw_text", F.lit(RAW_TEXT)), F.lit("")).alias("raw_text"),
        F.lit("").alias("thumbnail"), F.coalesce("line_items", F.array().cast(results.schema["line_items"].dataType)).alias("line_items"),
    )


def page_id(doc_id: Column, page_num: Column) -> Column:
    """Only pages after the first have an id of their own."""
    return F.when(page_num > 1, F.concat(doc_id, F.lit(":p"), page_num.cast("string")))


def representatives(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document instance: its page with the lowest number (name), the number of pages, and where it first appears.

    ``pages``: keys, pos, page_num (null counts as 1), name. Of equal page numbers the earliest row counts.
    """
    first = F.min_by("name", F.struct(F.coalesce("page_num", F.lit(1)).alias("p"), F.col("pos")))
    return pages.groupBy(*keys).agg(first.alias("name"), F.count(F.lit(1)).alias("n_pages"), F.min("pos").alias("first_pos"))


def sheets_by_type(rows: DataFrame, longest: int = 27) -> DataFrame:
    """One row per type (type, pos): n rows and a sheet name; later types with an equal name get (2), (3) and so on.

    The window runs over types that share one cut name.
    """
    types = rows.groupBy(F.coalesce("type", F.lit("未知类型")).alias("type")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    types = types.withColumn("_name", sheet_name(F.col("type"), longest))
    nth = F.row_number().over(Window.partitionBy("_name").orderBy("first_pos", "type"))
    name = F.when(nth == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("("), nth.cast("string"), F.lit(")")))
    return types.select("type", "n", name.alias("sheet"))


def best_confidence(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id and one column per field: the highest confidence of its filled candidates, 0 without one."""
    of = lambda f: F.coalesce(F.max(F.when((F.col("field") == f) & (F.coalesce("value", F.lit("")) != ""), F.col("confidence"))), F.lit(0.0)).alias(f)
    return candidates.groupBy("doc_id").agg(*[of(f) for f in fields])


def table_summary(items: DataFrame, key: str) -> DataFrame:
    """Sums of amount and tax per document, texts that are no numbers skipped, and the number of items."""
    total = lambda c: F.coalesce(F.sum(F.col(c).try_cast("decimal(18,2)")), F.lit(0)).cast("double")
    return items.groupBy(key).agg(total("amount").alias("total_amount"), total("tax").alias("total_tax"), F.count(F.lit(1)).alias("item_count"))


def column_at_center(center: Column, columns: list[tuple[str, float, float]]) -> Column:
    """Name of the first column whose bounds, both included, hold the center; null without one."""
    return F.coalesce(*[F.when((center >= a) & (center <= b), F.lit(name)) for name, a, b in columns])


def amount_column(lines: DataFrame, key: str, n_columns: int) -> DataFrame:
    """Per document the column (0-based) with the most digits among the right three, the leftmost of equals.

    ``lines``: key, col, text. A column without lines has density 0.
    """
    right = max(n_columns - 3, 0)
    density = [
        F.struct(
            F.coalesce(F.avg(F.when(F.col("col") == c, F.coalesce(F.col("text").rlike(r"\d"), F.lit(False)).cast("double"))), F.lit(0.0)).alias("share"),
            F.lit(-c).alias("minus"),
        )
        for c in range(right, n_columns)
    ]
    return lines.groupBy(key).agg((-F.array_max(F.array(*density))["minus"]).alias("amount_col"))


def row_boxes(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Per row the union of its boxes, the mean score, the median height (mean of the middle pair) and the joined text."""
    ordered = F.sort_array(F.collect_list(F.struct("x0", "pos", "text")))
    return tokens.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg("score").alias("score"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("median_height"),
        F.array_join(F.transform(ordered, lambda t: t["text"]), "").alias("text"),
    )


def without_empty_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, text) of the columns that have some text in a row."""
    filled = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*keys, "col").distinct()
    return cells.join(filled, [*keys, "col"], "left_semi")


def reviews_by_name(asked: DataFrame, reviews: DataFrame) -> DataFrame:
    """pos, record_id: the last review (file_name, pos, record_id) of each asked name (pos, name), trimmed and in lower case."""
    key = lambda c: F.lower(F.trim(c))
    last = reviews.groupBy(key("file_name").alias("_key")).agg(F.max_by("record_id", "pos").alias("record_id")).where("_key <> ''")
    return asked.withColumn("_key", key("name")).join(last, "_key").select("pos", "record_id")


def declared_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.groupBy(*keys).agg(F.max("declared").alias("declared"))


def key_union(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct keys of the maps ``fields`` of all pages of a document."""
    return pages.select(*keys, F.explode(F.map_keys("fields")).alias("_k")).groupBy(*keys).agg(F.sort_array(F.collect_set("_k")).alias("field_names"))
