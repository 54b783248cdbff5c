"""Dates kept as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "未知日期"


def date_text(text: Column) -> Column:
    """yyyy-MM-dd from common forms at the start of the text, without a calendar check; null otherwise."""
    t = F.regexp_replace(F.regexp_replace(text, "[年月]", "-"), "[日号]", "")
    at = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    part = lambda i: F.regexp_extract(t, at, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def invoice_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.nullif(text, F.lit(UNKNOWN)), r"(?:19|20)\d{2}", 0), F.lit("")).try_cast("int")


def is_previous_year(status: Column, text: Column, year: int) -> Column:
    return F.coalesce((status == "parsed") & (invoice_year(text) < year), F.lit(False))


def plausible_date(text: Column) -> Column:
    """Prefix test: year 2000 to 2100, month 1 to 12, day 1 to 31."""
    at = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    y, m, d = (F.regexp_extract(text, at, i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce(y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31), F.lit(False))


def date_confidence(text: Column, as_of: str, base: float = 0.8, low: float = 0.4) -> Column:
    """``low`` for dates before 2000 or more than 30 days after ``as_of``."""
    day = text.try_cast("date")
    odd = (day > F.date_add(F.lit(as_of).cast("date"), 30)) | (F.year(day) < 2000)
    return F.when(odd, F.lit(low)).otherwise(F.lit(base))


#: Dates with a label, then a bare one, by priority.
DATE_PATTERNS = (
    r"开票日期[:：]?\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?)",
    r"日期[:：]?\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?)",
    r"(\d{4}年\d{1,2}月\d{1,2}日)",
)


def first_date(text: Column) -> Column:
    """Labelled dates before bare ones, calendar-checked; '' if none."""
    hit = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DATE_PATTERNS])
    flat = date_text(hit)
    real = flat.try_cast("date")
    return F.coalesce(F.when(real.isNotNull(), flat), F.lit(""))


# The named date formats; what is not among them gives the last one.
DATE_FORMATS = {
    "YYYYMMDD": "$1$2$3", "YYYY年MM月DD日": "$1年$2月$3日", "YYYY年MM月DD": "$1年$2月$3", "YYYY-MM-DD": "$1-$2-$3", "YYYY.MM.DD": "$1.$2.$3",
    "YYYY/MM/DD": "$1/$2/$3", "MM月DD日": "$2月$3日", "MM-DD": "$2-$3", "MMDD": "$2$3", "MM/DD": "$2/$3",
}
DEFAULT_FORMAT = "$1年$2月$3日"


def date_in_format(text: Column, name: str) -> Column:
    """A yyyy-MM-dd text in a named format, other texts as they are; '' for null and the unknown date."""
    shaped = F.regexp_replace(text, r"^(\d{4})-(\d{2})-(\d{2})$", DATE_FORMATS.get(name, DEFAULT_FORMAT))
    return F.coalesce(F.nullif(shaped, F.lit(UNKNOWN)), F.lit(""))


def beijing_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO text: with Z in UTC, otherwise in Beijing time, whatever other offset it names."""
    local = F.concat(F.regexp_replace(text, r"[+-]\d{2}(:?\d{2})*$", ""), F.lit("+08:00"))
    instant = F.when(text.endswith("Z"), F.regexp_replace(text, "Z$", "+00:00")).otherwise(F.when(F.contains(text, F.lit(":")), local).otherwise(F.concat(text, F.lit("T00:00:00+08:00"))))
    return instant.try_cast("timestamp").cast("double")
