"""Amounts: parsing, rounding, checks of headers and lines, amounts in words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal tax rates.
RATES = (0.0, 0.01, 0.03, 0.05, 0.06, 0.09, 0.13, 0.17)
MARKS = r"[¥￥,\s]"




def safe_float(text: Column) -> Column:
    """Marks stripped; any minus sign makes the value negative; what is no number is 0."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)[¥￥,*\s]", "")
    value = F.coalesce(F.regexp_replace(t, "-", "").try_cast("double"), F.lit(0.0))
    return F.when(F.contains(t, F.lit("-")), -value).otherwise(value)


def amount_text(text: Column) -> Column:
    """Two decimals, null for what is no number; exact decimals, halves away from zero."""
    t = F.regexp_replace(text, r"[,¥￥ ]", "")
    return F.when(F.trim(text).isin("", "未知金额"), None).otherwise(t.try_cast("decimal(18,6)").cast("decimal(18,2)").cast("string"))


def round_money(x: Column) -> Column:
    """Half up on the absolute value, with a tiny allowance for binary fractions."""
    return F.signum(x) * F.floor((F.abs(x) + 1e-9) * 100 + 0.5) / 100


def leading_number(text: Column) -> Column:
    """The number a text starts with, marks ignored; null if there is none."""
    t = F.regexp_replace(text, MARKS, "")
    return F.nullif(F.regexp_extract(t, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def number_cell(text: Column) -> Column:
    """Struct of number and text for a spreadsheet cell: the number without commas if it is one, else the text; both null where empty."""
    number = F.regexp_replace(text, ",", "").try_cast("double")
    return F.struct(number.alias("number"), F.when(number.isNull() & (text != ""), text).alias("text"))


def quantity_cell(text: Column) -> Column:
    """As number_cell, but whole numbers stay texts, so that leading zeros are kept."""
    number = F.regexp_replace(text, ",", "").try_cast("double")
    part = F.when(number != F.floor(number), number)
    return F.struct(part.alias("number"), F.when(part.isNull() & (text != ""), text).alias("text"))


def rate_of(text: Column) -> Column:
    """A rate from '13%', '0.13' or '13'; exempt words are 0."""
    t = F.regexp_replace(F.trim(text), "免税|不征税", "0")
    v = F.regexp_replace(t, "%", "").try_cast("double")
    return F.when(F.contains(text, F.lit("%")), v / 100).otherwise(F.when(v > 1, v / 100).otherwise(v))


def nearest_rate(rate: Column) -> Column:
    best = F.array_min(F.array(*[F.struct(F.abs(rate - r).alias("gap"), F.lit(r).alias("rate")) for r in RATES]))
    return best["rate"]


def header_check(total: Column, net: Column, tax: Column) -> Column:
    """ok, note (0.01 < gap <= 0.1), warn (gap > 0.1), sign (negative total, positive part), none (total 0)."""
    t, n, x = (F.coalesce(c, F.lit(0.0)) for c in (total, net, tax))
    gap = F.abs(t - (n + x))
    return (
        F.when(t == 0, "none")
        .when((t < 0) & ((n > 0) | (x > 0)), "sign")
        .when((n == 0) & (x == 0), "ok")
        .when(gap > 0.1, "warn")
        .when(gap > 0.01, "note")
        .otherwise("ok")
    )


def line_check(quantity: Column, price: Column, net: Column, rate: Column, tax: Column) -> Column:
    """Array of the checks a line fails: price, tax, rate."""
    price_gap = F.abs(net - F.round(quantity * price, 2))
    want = F.round(F.abs(net) * rate, 2)
    tax_gap = F.abs(F.abs(tax) - want)
    return F.array_compact(
        F.array(
            F.when((net >= 0) & (price_gap > F.greatest(F.lit(0.05), F.abs(net) * 0.001)), F.lit("price")),
            F.when((rate > 0) & (tax_gap > F.greatest(F.lit(0.05), want * 0.01)), F.lit("tax")),
            F.when(F.abs(rate - nearest_rate(rate)) > 0.005, F.lit("rate")),
        )
    )


_DIGITS = "零壹贰叁肆伍陆柒捌玖"


def words_of(cents: int, signed: bool = True, whole_jiao: bool = False) -> str:
    """A cent amount in financial numerals. ``whole_jiao`` closes a missing last cent digit with 整."""
    sign, cents = ("负" if cents < 0 and signed else ""), abs(cents)
    whole, part = divmod(cents, 100)
    if not cents:
        return "零元整"
    out, gap, groups, rest = "", False, [], whole
    while rest:
        rest, g = divmod(rest, 10000)
        groups.append(g)
    for at in range(len(groups) - 1, -1, -1):
        g = groups[at]
        if not g:
            gap = bool(out)
            continue
        text, skipped = "", bool(out) and (gap or g < 1000)
        for place, name in ((1000, "仟"), (100, "佰"), (10, "拾"), (1, "")):
            d = g // place % 10
            if d:
                text += ("零" if skipped and (out or text) else "") + _DIGITS[d] + name
                skipped = False
            elif text:
                skipped = True
        out, gap = out + text + ("", "万", "亿", "万亿")[at], False
    jiao, fen = divmod(part, 10)
    tail = "整" if not part else (_DIGITS[jiao] + "角" if jiao else "零" if whole else "") + (_DIGITS[fen] + "分" if fen else "整" if whole_jiao else "")
    return sign + (out + "元" if whole else "") + tail


def amount_in_words(style: str = "plain"):
    """Arrow UDF from a decimal amount to words: ``plain`` (no sign), ``signed`` or ``closed`` (sign, and 角整)."""

    @F.pandas_udf(T.StringType())
    def words(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else words_of(int((v * 100).to_integral_value()), style != "plain", style == "closed"))

    return words


# Numerals and units that a running text may use; 万 and 亿 count the last digit only.
_NUMERALS = {c: i for row in (_DIGITS, " 一二三四五六七八九") for i, c in enumerate(row)}
_UNITS = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000, "万": 10000, "亿": 100000000, "元": 1, "圆": 1, "角": 0.1, "分": 0.01}


def running_text_amount(text: str | None) -> float | None:
    """Words to an amount; the first Arabic number in the text wins, with or without commas. None where nothing over 0 is found."""
    import re

    if not text:
        return None
    if (m := re.search(r"[\d,，]+\.?\d*", text)) and (plain := re.sub("[,，]", "", m[0])) not in ("", "."):
        return float(plain)
    total, digit = 0.0, 0
    for ch in text:
        if ch != " " and ch in _NUMERALS:
            digit = _NUMERALS[ch]
        elif ch in _UNITS:
            total, digit = total + digit * _UNITS[ch], 0
    return round(total + digit, 2) or None


@F.pandas_udf(T.DoubleType())
def words_to_amount(x: pd.Series) -> pd.Series:
    return x.map(running_text_amount).astype(float)
