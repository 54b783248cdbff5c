"""Cleaning of recognised texts: markers, names, misread digits, merged labels, tokens, table headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import numeric_token

# Internal markers, and the patterns at which a party name ends, by priority.
MARKERS = r"\[(?:BUYER|SELLER)_(?:START|END)\]|__AUX_[A-Za-z0-9_]+__"
BARE_MARKERS = ("BUYER_START", "BUYER_END", "SELLER_START", "SELLER_END")
PARTY_ENDS = (
    r"销\s*[:：]", "销售方信息", r"购\s*名\s*称[:：]", r"购买方\s*名\s*称[:：]", "购买方信息", "统一社会信用代码", "纳税人识别号", "项目名称", "规格型号",
)
# What is no person's name.
NO_PERSON = (
    "单位", "数量", "单价", "金额", "税率", "税额", "名称", "下载次数", "备注", "开票人", "收款人", "复核人", "价税合计", "合计", "小写", "大写",
    "旅客运输服务", "餐饮服务", "运输服务", "服务费",
)
NO_PERSON_PART = "发票|合计|金额|税|项目|规格|单位|数量|单价"
# Labels before which a single character of vertical text may stick.
STUCK_LABELS = (
    "统一社会信用代码/纳税人识别号：", "统一社会信用代码/纳税人识别号:", "纳税人识别号：", "纳税人识别号:", "统一社会信用代码：", "统一社会信用代码:",
)
# Places where O or I is a misread 0, in dates and in amounts.
DATE_ZEROS = (
    r"(?<=\D)[OI](?=\d{1,3}年)", r"(?<=\d)[OI](?=\d年)", r"(?<=年)[OI](?=\d月)", r"(?<=月)[OI](?=\d[日号])", r"(?<=\d)[OI](?=-\d)", r"(?<=-)[OI](?=\d)",
)
AMOUNT_ZEROS = (
    r"(?<=[0-9])[OI](?=[0-9])", r"(?<=[¥￥])[OI](?=[0-9])", r"(?<=[0-9])[OI](?=\.)", r"(?<=\.)[OI](?=[0-9])",
    r"(?<=\.\d)[OI](?=[^0-9A-Za-zOI]|$)", r"(?<=\.\d0)[OI](?=[^0-9A-Za-zOI]|$)", r"(?<=\.00)[OI](?=[^0-9A-Za-zOI]|$)",
    r"(?<=[0-9])[OI](?=[,，\s])", r"(?<=[,，])[OI](?=[0-9])", r"(?<=[:：])[OI](?=\.)", r"(?<=[:：])[OI](?=[0-9])", r"(?<=\s)[OI](?=[\d.])",
    r"(?<=\.)O(?=O[^0-9A-Za-z]|O$)",
)
# The forms of a token on an item line, by priority. What follows a doubled plus cannot begin with what it took.
TOKEN_FORMS = (
    r"[¥￥][\d,]++\.\d{2}", r"[¥￥][\d,]+", r"-?\d++(?:\.\d++)?%", r"-?[\d,]++\.\d{2}", r"-?\d++\.\d{3,4}",
    r"-?\d++(?:\.\d++)?(?:mm|cm|dm|m|km|g|kg|mg|ml|L|㎡|m²|m³|kv|kw|w|v|a|hz|db|px)", r"-?[\d,]+", r"[A-Za-z0-9][A-Za-z0-9\-/×xX.]*",
    r"[\x{4e00}-\x{9fff}]+", r"\S+",
)
# Tokens that are no item data.
TOKEN_TAX_ID = "^[0-9A-Za-z]{15,20}$"
TOKEN_DATE = r"^\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?$|^\d{4}\.\d{1,2}\.\d{1,2}$"
TOKEN_HEADER = (
    "发票代码|发票号码|开票日期|购买方|销售方|纳税人识别号|地址.?电话|开户行.?账号|机器编号|校验码|密码区|项目名称|规格型号|单位|数量|单价|金额|税率|税额|征收率|合计"
)
TOKEN_HEADER_CHARS = "数量单价金额税率项目名称规格型号征收"
TOKEN_COMPANY = "公司|有限|集团|中心|事务所|合作社|厂|行|部|室|处|协会|商会|医院|学校|银行|保险|基金|信托|证券"
UPPER_AMOUNT_CHARS = "零壹贰叁肆伍陆柒捌玖拾佰仟万亿元角分整负"
# Words of a header of six columns, and how many of them it must show.
SIX_COLUMNS = ("项目", "名称", "单价", "数量", "金额", "税率", "税额")
SIX_COLUMNS_LEAST = 5
# The columns of the full table.
FULL_HEADERS = ("项目名称", "规格型号", "单位", "数量", "单价", "金额", "税率/征收率", "税额")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value made once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with every match of the pattern replaced by a function of it."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), by)
    return F.array_join(F.zip_with(F.split(text, pattern), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def without_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKERS, " "), r"(?U)\s+", " "))


def party_name(text: Column) -> Column:
    """No markers, blanks or download counts; cut at the first end pattern, by priority, that does not stand at the begin."""

    def cut(name):
        ends = F.coalesce(*[F.nullif(F.greatest(F.regexp_instr(name, F.lit(p)) - 1, F.lit(0)), F.lit(0)) for p in PARTY_ENDS], F.length(name))
        return F.trim(F.left(name, ends))

    plain = F.regexp_replace(without_markers(F.coalesce(text, F.lit(""))), "[　 ]", "")
    return bound(F.regexp_replace(plain, r"下载次数[:：]?\d+.*$", ""), cut)


def person_name(text: Column) -> Column:
    """'' for labels, for texts with parts of labels and for more than 12 characters."""
    bad = lambda name: name.isin(*NO_PERSON) | (F.length(name) > 12) | name.rlike(NO_PERSON_PART)
    return bound(without_markers(F.coalesce(text, F.lit(""))), lambda name: F.when(bad(name), "").otherwise(name))


def note_text(text: Column) -> Column:
    return bound(without_markers(F.coalesce(text, F.lit(""))), lambda note: F.when(note.isin(*BARE_MARKERS), "").otherwise(note))


def ocr_fixed(text: Column) -> Column:
    """Letters read for digits: in labelled numbers, in dates, in amounts (three passes) and in tax ids."""
    digits = lambda hit: F.translate(F.regexp_replace(hit, r"\s", ""), "OoIl", "0011")
    for label in ("发票号码", "票据号码"):
        text = replaced(text, label + r"[:：]\s*[0-9OIol]+", digits)
    for place in (*DATE_ZEROS, *AMOUNT_ZEROS * 3):
        text = F.regexp_replace(text, place, "0")
    return replaced(text, r"纳税人识别号[:：]\s*[0-9A-Za-z]+", lambda hit: F.translate(F.upper(F.regexp_replace(hit, r"\s", "")), "O", "0"))


def split_labels(lines: Column) -> Column:
    """Array of lines; a line that is one CJK character before a label becomes that character and the label alone."""

    def parts(line):
        label = F.coalesce(*[F.when(F.trim(line).rlike(r"^[\x{4e00}-\x{9fff}]" + name), F.lit(name)) for name in STUCK_LABELS])
        return F.when(label.isNotNull(), F.array(F.left(F.trim(line), F.lit(1)), label)).otherwise(F.array(line))

    return F.flatten(F.transform(lines, parts))


def _led(words: str) -> str:
    """The alternatives, tried only where one of their first characters stands."""
    return f"(?=[{''.join(sorted({w[0] for w in words.split('|')}))}])(?:{words})"


def no_item_token(token: Column) -> Column:
    """True for numbers of 8 to 20 digits that are no bar codes, tax ids, dates, amounts in words, labels, companies and long decimals."""

    def test(t):
        # Labels, companies and amounts in words are looked for only in tokens that hold more than ASCII.
        wide = F.octet_length(t) != F.length(t)
        words = F.length(t) - F.length(F.translate(t, UPPER_AMOUNT_CHARS, ""))
        labels = t.rlike(f"{_led(TOKEN_HEADER)}|^[{TOKEN_HEADER_CHARS}]$") | ((F.length(t) >= 2) & (2 * words > F.length(t))) | ((F.length(t) >= 6) & t.rlike(_led(TOKEN_COMPANY)))
        forms = t.rlike("|".join((TOKEN_TAX_ID, TOKEN_DATE, r"^-?\d+\.\d{3,}$")))
        other = (t == "") | ((F.length(t) >= 5) & forms) | (wide & labels)
        digits = (F.length(t) >= 8) & t.rlike(r"^[ ,]*\d[ ,\d]{7,}$")
        plain = F.translate(t, " ,", "")
        return F.when(digits & plain.rlike(r"^\d{8,20}$"), ~plain.rlike(r"^(\d{8}|\d{12,14})$")).otherwise(other)

    return bound(token, test)


def item_tokens(line: Column) -> Column:
    """Tokens of an item line without those that are no item data, digits mended; a line without data is one token."""

    def tokens(flat):
        found = F.filter(F.regexp_extract_all(flat, F.lit("|".join(TOKEN_FORMS)), F.lit(0)), lambda t: ~no_item_token(t))
        whole = (flat != "") & ~flat.rlike(r"[\d¥￥%.,]")
        return bound(F.transform(found, numeric_token), lambda got: F.when((F.size(got) == 0) & whole, F.array(flat)).otherwise(got))

    return bound(F.trim(F.coalesce(line, F.lit(""))), tokens)


def column_format(header: Column) -> Column:
    """8col, 6col or unknown: the wide table names a specification or unit, the narrow one has its price before its quantity."""
    has = lambda t, w: F.contains(t, F.lit(w)).cast("int")

    def kind(t):
        wide = (has(t, "规") + has(t, "格") == 2) | (has(t, "单") + has(t, "位") == 2)
        hits = sum((has(t, w) for w in SIX_COLUMNS), F.lit(0))
        return F.when(wide, "8col").when((hits >= SIX_COLUMNS_LEAST) & t.rlike("^[^量]*价.*量"), "6col").otherwise("unknown")

    return bound(F.regexp_replace(F.coalesce(header, F.lit("")), "[\n \t]", ""), kind)


def merged_bounds(bounds: Column, headers: Column) -> Column:
    """Column bounds without those between neighbours whose headers name the same full column, or none both."""

    def named(cell):
        t = F.regexp_replace(cell, r"(?U)\s+", "")
        hit = lambda w: (t != "") & (F.contains(F.lit(w), t) | F.contains(t, F.lit(w)))
        return F.coalesce(*[F.when(hit(w), i) for i, w in enumerate(FULL_HEADERS)], F.lit(-1))

    at = lambda names, i: F.coalesce(F.get(names, i), F.lit(-1))
    kept = bound(F.transform(headers, named), lambda names: F.filter(bounds, lambda b, i: at(names, i) != at(names, i + 1)))
    return F.when(F.size(headers) > 0, kept).otherwise(bounds)


def char_boxes(text: Column, x0: Column, x1: Column) -> Column:
    """Array of (char, x0, x1): the width shared by weights, 1.5 for CJK, 0.6 for narrow marks, 0.5 for a blank, else 1."""
    weigh = lambda c: F.when(c.rlike(r"[\x{4e00}-\x{9fff}]"), 1.5).when(c.isin(*".,-·"), 0.6).when(c == " ", 0.5).otherwise(1.0)

    def place(weights):
        total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
        ends = F.aggregate(weights, F.array(F.lit(0.0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w)))
        at = lambda e: x0 + (x1 - x0) * e / total
        return bound(F.transform(ends, at), lambda xs: F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("char"), F.get(xs, i).alias("x0"), F.get(xs, i + 1).alias("x1"))))

    boxes = bound(F.transform(F.split(text, ""), weigh), place)
    return F.when(F.length(text) > 0, boxes)


def region_text(regions: Column, *names: str) -> Column:
    """Filled regions of a map of line arrays, in the order asked for, a line each."""
    texts = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_join(F.try_element_at(regions, n), "\n"))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def archive_name(prefix: Column, date: Column, kind: str = "ZIP", order: tuple[str, ...] = ("prefix", "date")) -> Column:
    """Filled parts with _ between them, and the ending of the kind."""
    parts = {"prefix": F.when(F.trim(prefix) != "", prefix), "date": F.nullif(date, F.lit(""))}
    ending = {"RAR": ".rar", "7Z": ".7z"}.get(kind, ".zip")
    return F.concat(F.concat_ws("_", *[parts[p] for p in order if p in parts]), F.lit(ending))
