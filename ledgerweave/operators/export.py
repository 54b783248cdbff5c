"""Flat export rows, column choice and CSV."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.text import cell_text
from ledgerweave.operators.stats import serial_numbers

#: Export columns in canonical order.
COLUMNS = (
    "serialNo", "invoiceType", "invoiceDate", "invoiceNumber", "amountWithoutTax", "taxAmount", "totalAmount", "buyerName",
    "buyerTaxNo", "sellerName", "sellerTaxNo", "issuer", "classificationCode", "xmmc", "ggxh", "unit", "quantity",
    "unitPrice", "lineAmount", "taxRate", "lineTax", "note", "originalFilename",
)
LINE_FIELDS = {"xmmc": "xmmc", "ggxh": "ggxh", "dw": "unit", "sl": "quantity", "dj": "unitPrice", "je": "lineAmount", "slv": "taxRate", "se": "lineTax"}


def class_code(name: Column) -> Column:
    return F.regexp_extract(name, r"^\*([^*]+)\*", 1)


def flatten(invoices: DataFrame) -> DataFrame:
    """Header columns repeated per line; an invoice without lines gives one row."""
    rows = invoices.select("*", F.explode_outer("line_items").alias("_l")).drop("line_items")
    rows = rows.withColumns({to: F.col(f"_l.{c}") for c, to in LINE_FIELDS.items()}).drop("_l")
    return rows.withColumn("classificationCode", class_code(F.coalesce("xmmc", F.lit(""))))


def chosen(columns: list[str] | None) -> list[str]:
    """Known columns in the order asked for; all of them without a request."""
    return [c for c in columns or COLUMNS if c in COLUMNS] or list(COLUMNS)


def visible(columns: list[str]) -> list[str]:
    """Known columns in canonical order."""
    return [c for c in COLUMNS if c in columns]


def checked_path(path: str, kind: str) -> str:
    if not posixpath.isabs(path) or ".." in path.split("/") or not path.endswith("." + kind):
        raise ValueError(f"not an absolute .{kind} path: {path}")
    return posixpath.normpath(path)


def grouped(rows: DataFrame, key: str = "identity", pos: str = "pos") -> DataFrame:
    """Rows with serialNo, one number per invoice in order of first appearance, the rows of an invoice together."""
    return serial_numbers(rows, key, pos).withColumnRenamed("serial", "serialNo").orderBy("serialNo", pos)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV parts with a header, texts made safe for spreadsheets, numbers as they are.

    Every part begins with a byte-order mark, so that spreadsheets read it as UTF-8.
    """
    names = [c for c in chosen(columns) if c in rows.columns]
    kinds = dict(rows.dtypes)
    safe = [cell_text(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in names]
    marked = rows.select(*safe)
    marked = marked.withColumnRenamed(names[0], "\ufeff" + names[0])
    marked.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)
