"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, LIMIT = 1024, 4 * 1024 * 1024


def doc_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 24)


def record_hash(content: Column) -> Column:
    """Whole content up to 4 MiB, beyond it head, middle, tail and length."""
    n = F.length(content)
    piece = lambda at: F.substring(content, at, F.lit(HEAD))
    middle = (n / 2).cast("int") + 1
    parts = F.concat(piece(F.lit(1)), piece(middle), piece(n - HEAD + 1), n.cast("string").cast("binary"))
    return F.sha2(F.when(n <= LIMIT, content).otherwise(parts), 256)


def version_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def etag(content_hash: Column, preset: Column, view_state: Column, version: Column, highlight: Column) -> Column:
    """First 16 hex digits of the md5 of everything a rendering depends on."""
    return F.left(F.md5(F.concat(content_hash, F.lit("|"), preset, F.lit("|"), view_state, F.lit("|v"), version, F.lit("|hl:"), highlight)), F.lit(16))


def cache_key(doc_id: Column, preset: Column, page: Column, view_state: Column, highlight: Column) -> Column:
    """Parts with bars between them; empty view states and highlights are left out."""
    marked = F.when(highlight != "", F.concat(F.lit("hl:"), highlight))
    return F.concat_ws("|", doc_id, preset, page.cast("string"), F.nullif(view_state, F.lit("")), marked)


def hex_id(raw: Column) -> Column:
    """An id of 32 hex digits from a decimal text of up to 38 digits; ids that already have that form, and others, stay."""
    number = F.when(~raw.rlike(r"^[0-9a-fA-F]{32}$"), F.trim(raw)).try_cast("decimal(38,0)")
    half = F.lit("18446744073709551616").cast("decimal(20,0)")
    low = number % half
    word = lambda x: F.lower(F.lpad(F.conv(x.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))
    return F.when(number >= 0, F.concat(word((number - low) / half), word(low))).otherwise(raw)
