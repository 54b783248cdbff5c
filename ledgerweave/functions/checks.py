"""Checks and scores of fields: clashes, amounts in words, candidate and layout scores, safety nets of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.cleaning import bound

# Points of a party candidate.
BASE_POINTS = 30
SOURCE_POINTS = {"bbox_l1_label": 25, "bbox_l2_anchor": 40, "bbox_l3_region": 20}
NAME_POINTS, TAX_POINTS, GOODS_POINTS, NUMBER_POINTS, ITEM_POINTS = 15, 20, -15, -30, -40
# Words of companies, addresses and banks.
COMPANY_WORDS = (
    "有限公司", "股份有限公司", "集团", "科技", "实业", "发展", "贸易", "投资", "有限责任", "有限", "股份",
    "税务局", "税务", "海关", "财政局", "工商局", "公安局", "法院", "检察院", "政府", "厅", "局", "委员会", "办公室",
    "医院", "学校", "大学", "学院", "中学", "小学", "幼儿园", "研究院", "研究所", "科学院", "中心", "协会", "学会", "联合会",
    "银行", "证券", "保险", "基金", "公司", "厂", "矿", "场", "站", "所", "队", "部", "处", "科", "室",
)
ADDRESS_WORDS = ("路", "街", "号", "区", "市", "省", "大厦", "楼", "巷", "镇", "村", "弄")
BANK_WORDS = ("银行", "支行", "账号", "账户", "开户行", "开户银行", "网点")


def field_clashes(number: Column, parties: tuple[Column, Column], tax_ids: tuple[Column, Column], people: tuple[Column, ...], number_conf: Column, party_confs: tuple[Column, Column]) -> Column:
    """Struct: warnings, and the confidences (0.8 where null) of number, buyer and seller after their caps.

    Equal parties cap both at 0.5, a tax id equal to the number caps the number at 0.4, a number that is not 8 to 20 digits at 0.5.
    """
    filled = lambda c: F.nullif(c, F.lit(""))
    same = F.coalesce(filled(parties[0]) == parties[1], F.lit(False))
    is_tax = F.coalesce(filled(number) == tax_ids[0], F.lit(False)) | F.coalesce(filled(number) == tax_ids[1], F.lit(False))
    known = F.nullif(filled(number), F.lit("未知号码"))
    odd = F.coalesce(~F.regexp_replace(known, " ", "").rlike(r"^\d{8,20}$"), F.lit(False))
    names = F.array_compact(F.array(*map(filled, people)))
    alike = (F.size(names) >= 2) & (F.size(F.array_distinct(names)) == 1)
    base = lambda c: F.coalesce(c, F.lit(0.8))
    cap = lambda c, *tests: F.least(base(c), *[F.when(t, limit) for t, limit in tests])
    said = [(same, "same_party"), (is_tax, "tax_is_number"), (odd, "number_format"), (alike, "same_people")]
    return F.struct(
        F.array_compact(F.array(*[F.when(t, F.lit(w)) for t, w in said])).alias("warnings"),
        cap(number_conf, (is_tax, 0.4), (odd, 0.5)).alias("number"),
        cap(party_confs[0], (same, 0.5)).alias("buyer"),
        cap(party_confs[1], (same, 0.5)).alias("seller"),
    )


def words_checked(in_words: Column, total: Column, confidence: Column) -> Column:
    """The confidence (0.8 where null), at most 0.6 where the value of the words is more than 0.5 off a total other than 0."""
    off = (total != 0) & (F.abs(F.abs(in_words) - F.abs(total)) > 0.5)
    base = F.coalesce(confidence, F.lit(0.8))
    return F.when(off, F.least(base, F.lit(0.6))).otherwise(base)


def candidate_score(source: Column, is_name: Column, well_formed: Column, goods: Column, bank_branch: Column, near_number: Column, in_items: Column) -> Column:
    """Points from 0 to 100; goods and bank branches count against names only."""
    points = F.lit(BASE_POINTS)
    for name, more in SOURCE_POINTS.items():
        points = points + F.when(source == name, more).otherwise(0)
    add = lambda test, more: F.when(test, more).otherwise(0)
    points = points + add(is_name & well_formed, NAME_POINTS) + add(~is_name & well_formed, TAX_POINTS)
    points = points + add(is_name & goods, GOODS_POINTS) + add(is_name & bank_branch, GOODS_POINTS)
    points = points + add(near_number, NUMBER_POINTS) + add(in_items, ITEM_POINTS)
    return F.least(F.greatest(points, F.lit(0)), F.lit(100))


def layout_scores(text: Column) -> Column:
    """Struct of company, tax_id, address and bank scores up to 1, and the best one's name, the first of equals."""
    hits = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    longer = lambda *steps: sum((F.when(F.length(text) >= n, more).otherwise(0.0) for n, more in steps), F.lit(0.0))
    one = lambda x: F.least(x, F.lit(1.0))
    scores = {
        "company": one(hits(COMPANY_WORDS) * 0.15 + longer((4, 0.3), (8, 0.2), (12, 0.1))),
        "tax_id": F.when(text.rlike("^[0-9A-Z]{15,20}$"), 1.0).otherwise(0.0),
        "address": one(hits(ADDRESS_WORDS) * 0.2 + longer((8, 0.4), (12, 0.2))),
        "bank": one(hits(BANK_WORDS) * 0.3 + F.when(text.rlike(r"\d{10,}"), 0.3).otherwise(0.0)),
    }
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("minus"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())]))
    return F.struct(*[s.alias(n) for n, s in scores.items()], best["name"].alias("best"))


def amount_or_sum(current: Column, line_sum: Column, other: Column, total: Column, strip_commas: bool = True) -> Column:
    """The header amount (a text), or the sum of the lines (decimal, null without any number).

    The sum stands in for an empty amount, for one that is no number, and for one more than 1.0 off, unless amount and
    ``other`` make up ``total`` within 0.02.
    """
    value = (F.regexp_replace(current, ",", "") if strip_commas else current).try_cast("double")
    whole = value + F.regexp_replace(other, ",", "").try_cast("double") - F.nullif(total, F.lit("")).try_cast("double")
    fits = F.coalesce(F.abs(F.round(whole, 6)) <= 0.02, F.lit(False))
    keeps = line_sum.isNull() | (value.isNotNull() & (fits | (F.abs(F.round(value - line_sum.cast("double"), 6)) <= 1.0)))
    return F.when(keeps, current).otherwise(line_sum.cast("decimal(18,2)").cast("string"))


def derived_item(quantity: Column, price: Column, amount: Column, rate: Column, tax: Column) -> Column:
    """Struct of texts amount, rate, tax: missing ones derived from the others, then amount and tax corrected beyond 0.01.

    Two decimals, halves away from zero; a rate is a number of percent with or without its sign. Empty texts count as missing,
    and a text that is no number is neither used nor corrected.
    """
    money = "decimal(18,6)"
    number = lambda c: F.when(F.contains(c, F.lit("%")), F.regexp_replace(c, "%+$", "")).otherwise(c).try_cast(money)
    cents = lambda c: F.round(c, 2).cast("decimal(18,2)")
    off = lambda want, have: F.coalesce(F.abs(want - have) > F.lit("0.01").cast("decimal(4,2)"), F.lit(False))
    names, given = ("quantity", "price", "amount", "rate", "tax"), (quantity, price, amount, rate, tax)

    # Every step is a struct that is made once and read by the next; a derived number stays one beside its text.
    def parsed(t):
        return bound(F.struct(*[t[n].alias(n) for n in names[2:]], *[number(t[n]).alias(f"{n}_n") for n in names]), first)

    def first(x):
        product = x["quantity_n"] * x["price_n"]
        wrong = x["amount"].isNull() | off(product, x["amount_n"])
        found_tax = F.when(x["tax"].isNull(), cents(x["amount_n"] * x["rate_n"] / 100))
        return bound(F.struct(x.alias("x"), F.when(wrong, cents(product)).alias("amount"), found_tax.alias("tax")), second)

    def second(y):
        x = y["x"]
        tax_n = F.when(x["tax"].isNull(), y["tax"].try_cast(money)).otherwise(x["tax_n"])
        found_rate = F.when(x["rate"].isNull() & (x["amount_n"] > 0), cents(tax_n / x["amount_n"] * 100))
        return bound(F.struct(x.alias("x"), y["amount"].alias("amount"), y["tax"].alias("tax"), tax_n.alias("tax_n"), found_rate.alias("rate")), third)

    def third(z):
        x = z["x"]
        amount_n = F.when(z["amount"].isNull(), x["amount_n"]).otherwise(z["amount"].try_cast(money))
        rate_n = F.when(x["rate"].isNull(), z["rate"].try_cast(money)).otherwise(x["rate_n"])
        return bound(F.struct(z.alias("z"), (amount_n * rate_n / 100).alias("due")), last)

    def last(w):
        x, z = w["z"]["x"], w["z"]
        rate = F.coalesce(x["rate"], F.concat(z["rate"].cast("string"), F.lit("%")))
        tax = F.when(off(w["due"], z["tax_n"]), cents(w["due"]).cast("string")).otherwise(F.coalesce(x["tax"], z["tax"].cast("string")))
        return F.struct(F.coalesce(z["amount"].cast("string"), x["amount"]).alias("amount"), rate.alias("rate"), tax.alias("tax"))

    return bound(F.struct(*[F.nullif(c, F.lit("")).alias(n) for n, c in zip(names, given)]), parsed)
