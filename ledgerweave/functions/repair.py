"""Repair of headers and lines, names for renamed files, fixed-size groups."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ledgerweave.functions.money import nearest_rate


def repaired_header(total: Column, net: Column, tax: Column) -> Column:
    """Struct of total, net, tax with one missing part derived; a missing tax of equal total and net is 0."""
    t, n, x = total, net, tax
    t2 = F.coalesce(t, F.round(n + x, 2), n)
    n2 = F.coalesce(n, F.round(t - x, 2))
    x2 = F.coalesce(x, F.when(t == n, 0.0), F.round(t - n, 2))
    return F.struct(t2.alias("total"), n2.alias("net"), x2.alias("tax"))


def balanced_header(total: Column, net: Column, tax: Column) -> Column:
    """Struct of total, net, tax after the arithmetic check; null stands for a missing part.

    Sums within 0.02, or within 1% of the total, stay as they are, red invoices too. A tax of 0 is written out where net and total
    agree; otherwise the tax gives way to the total, a missing tax is the rest of the total if that is over 0, and so is a missing net.
    """
    n, x = F.coalesce(net, F.lit(0.0)), F.coalesce(tax, F.lit(0.0))
    off = F.abs(n + x - total)
    close = (off <= 0.02) | (off / F.greatest(F.abs(total), F.lit(1.0)) <= 0.01)
    rest, rest_net = F.round(total - n, 2), F.round(total - x, 2)
    red = (total < 0) & (n < 0) & (x <= 0) & close
    free = (x == 0) & ((n == total) | (~red & (F.abs(n - total) <= 0.02)))
    none = total.isNull() | (net.isNull() & tax.isNull())
    new_tax = (
        F.when(none, tax).when(free, 0.0).when(close, tax).when(net.isNotNull() & tax.isNotNull(), rest)
        .when(net.isNotNull() & (rest > 0), rest).otherwise(tax)
    )
    new_net = F.when(~none & ~close & net.isNull() & (rest_net > 0), rest_net).otherwise(net)
    return F.struct(total.alias("total"), new_net.alias("net"), new_tax.alias("tax"))


def repaired_line(net: Column, rate: Column, tax: Column) -> Column:
    """Struct of net, rate, tax: a missing tax from the rate, a missing rate from the tax (nearest legal one)."""
    return F.struct(
        net.alias("net"),
        F.coalesce(rate, F.when(net != 0, nearest_rate(F.abs(tax / net)))).alias("rate"),
        F.coalesce(tax, F.round(net * rate, 2)).alias("tax"),
    )


def shifted_amount(quantity: Column, price: Column, net: Column) -> Column:
    """Net amount if quantity times price agrees after moving its decimal point by up to three places, else null."""
    want = quantity * price
    fits = [F.when(F.abs(net * f - want) <= F.greatest(F.lit(0.05), F.abs(want) * 0.001), net * f) for f in (1.0, 0.1, 10.0, 0.01, 100.0, 0.001, 1000.0)]
    return F.coalesce(*fits)


def best_quantity_price(numbers: Column, net: Column) -> Column:
    """Of up to four candidate numbers the ordered pair whose product is nearest to the net amount."""
    four = F.slice(numbers, 1, 4)
    pairs = F.flatten(F.transform(four, lambda q, i: F.transform(F.filter(four, lambda p, j: j != i), lambda p: F.struct(F.abs(q * p - net).alias("gap"), q.alias("quantity"), p.alias("price")))))
    return F.array_min(pairs)


def named(parts: list[Column], separator: str = "_", each: int = 80, whole: int = 210, fallback: str = "未命名") -> Column:
    """File name of the non-empty parts, each and the whole cut to length."""
    clean = [F.nullif(F.substring(F.trim(F.regexp_replace(p.cast("string"), r'[<>:"/\\|?*\x00-\x1f]', "")), 1, each), F.lit("")) for p in parts]
    name = F.substring(F.concat_ws(separator, *clean), 1, whole)
    return F.when(name == "", fallback).otherwise(name)


def collision_name(name: Column, keys: list[str], order: str) -> Column:
    """The n-th arrival of one name gets _n before its extension, the first keeps it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return F.when(n == 0, name).otherwise(F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1_"), n.cast("string"), F.lit("$2"))))


def chunk_of(position: Column, size: int) -> Column:
    """0-based group of a 0-based position in groups of ``size``."""
    return F.floor(position / size)


def item_parts(text: Column) -> Column:
    """A merged line cut before every *code*, empty parts dropped."""
    return F.filter(F.split(text, r"(?=\*[^*]{1,20}\*)"), lambda x: F.trim(x) != "")
