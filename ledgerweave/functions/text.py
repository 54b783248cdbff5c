"""String expressions: names, labels, digits and searchable text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File extensions that count as pictures, and their media types.
IMAGE_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff",
}
FORMULA_STARTS = ("=", "+", "-", "@")


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode NFC; there is no built-in form. Apply it to distinct names only."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def name_key(name: Column) -> Column:
    """File name key without the NFC step: no white space at all, lower case; '' for null."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""))


def without_page_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"_p\d+\.([^.]+)$", ".$1")


def original_name(name: Column) -> Column:
    """As ``without_page_suffix``, for PDF names in any case only."""
    return F.regexp_replace(name, r"(?i)_p\d+(\.pdf)$", "$1")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(name: Column) -> Column:
    parts = F.split(F.coalesce(name, F.lit("")), r"\.")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1))).otherwise("")


def file_format(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext == "ofd", "ofd").when(ext.isin(*IMAGE_TYPES), "image").otherwise("pdf")


def media_type(ext: Column) -> Column:
    out = F.when(ext == "ofd", "application/ofd")
    for k, v in IMAGE_TYPES.items():
        out = out.when(ext == k, v)
    return out.otherwise("application/pdf")


def cell_text(value: Column) -> Column:
    """Collapse white space and put a quote before what a spreadsheet would take for a formula."""
    flat = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    risky = flat.startswith(FORMULA_STARTS[0])
    for c in FORMULA_STARTS[1:]:
        risky = risky | flat.startswith(c)
    return F.when(risky, F.concat(F.lit("'"), flat)).otherwise(flat)


def sheet_name(name: Column, longest: int = 31) -> Column:
    cut = F.substring(F.regexp_replace(name, r"[\[\]*/\\?:]", "_"), 1, longest)
    return F.when(cut == "", "Sheet").otherwise(cut)


def name_segment(name: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', ""), r"\.\.", "")
    return F.when(F.trim(cut) == "", "未知").otherwise(F.trim(cut))


def company_name(name: Column) -> Column:
    """Drop white space between two CJK characters."""
    return F.regexp_replace(name, r"(?U)([\x{4e00}-\x{9fff}])\s+([\x{4e00}-\x{9fff}])", "$1$2")


def digit_fix(text: Column) -> Column:
    """Letters that stand for digits: everywhere in a digit-like text, otherwise O beside a digit."""
    like = text.rlike(r"^[0-9OoIl]+$") & text.rlike("[0-9]")
    beside = F.regexp_replace(text, r"(?<=[0-9])[Oo]|[Oo](?=[0-9])", "0")
    return F.when(like, F.translate(text, "OoIl", "0011")).otherwise(beside)


def numeric_token(token: Column) -> Column:
    """Map O, I, l, S, B to digits if the whole result is then a number."""
    number = token.rlike(r"^-?[\dOoIlSB]+(\.[\dOoIlSB]+)?%?$")
    return F.when(number, F.translate(token, "OoIlSB", "001158")).otherwise(token)


def distinct_lines(text: Column) -> Column:
    """Trimmed non-empty lines, first occurrences, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(lines), "\n")


def compare_key(text: Column) -> Column:
    """For comparing recognised lines: no white space or ASCII punctuation, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", ""))


def natural_key(name: Column) -> Column:
    """Binary order of the key is natural order: digit runs of any length are led by their length without leading zeros."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), _counted(F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(r)), "")


def _counted(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)


def search_text(*fields: Column) -> Column:
    """Fields with a blank between them, empty ones too, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def client_search_text(*fields: Column) -> Column:
    """Non-empty fields with a bar between them, in lower case."""
    return F.lower(F.concat_ws("|", *[F.nullif(f, F.lit("")) for f in fields]))


def normalized_text(text: Column) -> Column:
    """One line: full-width colons become plain ones, white space runs one blank."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "：", ":")
    return F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))


#: Header words that may be written with blanks inside.
SPACED_HEADERS = ("单位", "金额", "税率", "税额", "数量", "单价", "规格型号", "征收率")


def header_cell(cell: Column) -> Column:
    """A header cell without blanks around it or inside its known words."""
    out = F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")
    for word in SPACED_HEADERS:
        out = F.regexp_replace(out, r"(?U)" + r"\s*".join(word), word)
    return out


def unique_headers(headers: Column, names: dict[str, str] | None = None) -> Column:
    """Cleaned headers, by the names in ``names`` if there; a blank one is called by its place (列0, 列1, ...), the second of equal ones gets _1, the third _2."""
    clean = F.transform(headers, header_cell)
    if names:
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        clean = F.transform(clean, lambda h: F.coalesce(F.try_element_at(known, h), h))
    clean = F.transform(clean, lambda h, i: F.when(h == "", F.concat(F.lit("列"), i.cast("string"))).otherwise(h))
    before = lambda h, i: F.size(F.filter(F.slice(clean, F.lit(1), i), lambda x: x == h))
    return F.transform(clean, lambda h, i: F.when(before(h, i) > 0, F.concat(h, F.lit("_"), before(h, i).cast("string"))).otherwise(h))
