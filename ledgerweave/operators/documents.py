"""Facts of documents and pages: kinds, elements of two sources, merged rows, project names.

What a page or document holds is gathered in one row; it is as large as that page or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.cleaning import bound

_BOX = "struct<cy:double,pos:bigint,x0:double,x1:double,y0:double,y1:double,text:string,score:double>"
# Forms of rates, prices and category codes, and the words of table headers.
RATE = r"\d+%|免税|0%|6%|9%|13%"
PRICE = r"[¥￥]?\s*[\d,]+\.\d{2}"
HEADER_LINE = "(项目名称|货物或应税劳务|服务名称).*(金额|税率|单价)"
GOODS_LINE = r"(?:货物或应税劳务|服务名称)[:\s]*(.+?)(?:\s+\d|\s+¥|$)"
STAR_LINE = r"(\*[^*]+\*[^\d*].*?)(?:\s+[\d,]+\.\d{2}|\s+\d+%|\s+免税|\s+0%|\s+6%|\s+9%|\s+13%|$)"
CJK = r"[\x{4e00}-\x{9fa5}]"


def document_kinds(pages: DataFrame) -> DataFrame:
    """doc_id, kind: image if more than half of the pages (doc_id, text, n_images) have a picture and under 10 characters, else text."""
    picture = (F.length(F.trim(F.coalesce("text", F.lit("")))) < 10) & (F.col("n_images") > 0)
    share = F.sum(F.coalesce(picture, F.lit(False)).cast("int")) * 2 > F.count(F.lit(1))
    return pages.groupBy("doc_id").agg(F.when(share, "image").otherwise("text").alias("kind"))


# Words whose presence shows a readable text layer, and words of an invoice's parts.
SCORE_WORDS = ("发票", "号码", "日期", "购买方", "销售方", "金额", "合计")
PART_WORDS = (
    ("项目名称", "规格型号", "单位", "数量", "单价"), ("金额", "税额", "税率", "价税合计", "合计"), ("购买方", "销售方", "购方", "销方"),
    ("统一社会信用代码", "纳税人识别号"), ("发票号码", "开票日期", "发票类型"), ("备注", "收款人", "复核人", "开票人"), ("机打代码", "机器编号"), ("大写",),
)


def text_score(text: Column) -> Column:
    """How many of the seven SCORE_WORDS the text holds, blanks and line feeds left out; 0 for null."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\n ]", "")
    return sum((F.contains(flat, F.lit(w)).cast("int") for w in SCORE_WORDS), F.lit(0))


def weak_layer(n_tokens: Column, n_rows: Column, text: Column) -> Column:
    """True for a text layer that needs recognition: under 40 tokens, more than a row for two tokens, or words of fewer than two parts."""
    held = lambda words: F.coalesce(text, F.lit("")).rlike("|".join(words)).cast("int")
    parts = sum((held(words) for words in PART_WORDS), F.lit(0))
    return (n_tokens < 40) | (n_rows > 0.5 * F.greatest(n_tokens, F.lit(1))) | (parts < 2)


def referenced(documents: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that some file refers to; the others are dropped."""
    return documents.join(files.select(key), key, "left_semi")


def needs_ocr(text: Column) -> Column:
    """True under 20 characters, line feeds and blanks not counted."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\n ]", ""))) < 20


def merged_elements(known: DataFrame, found: DataFrame, keys: list[str], overlap: float = 0.5, near: float = 30.0) -> DataFrame:
    """Elements (keys, pos, page, text, x0, y0, x1, y1) of both in reading order: page, y, x.

    A found element goes if its IoU with one kept so far is over ``overlap``, or if one text holds the other and the centers are
    less than ``near`` apart. Found elements come in order of ``pos``, and are compared with those kept before them.
    """
    element = F.struct("pos", "page", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    gather = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias(name))
    both = gather(known, "_known").join(gather(found, "_found"), keys, "full")
    none = lambda c: F.filter(c, lambda _: F.lit(False))
    first, then = F.coalesce("_known", none("_found")), F.coalesce("_found", none("_known"))
    area = lambda e: (e["x1"] - e["x0"]) * (e["y1"] - e["y0"])
    center = lambda e, c: (e[c + "0"] + e[c + "1"]) / 2

    def same(e, m):
        w = F.greatest(F.least(e["x1"], m["x1"]) - F.greatest(e["x0"], m["x0"]), F.lit(0.0))
        h = F.greatest(F.least(e["y1"], m["y1"]) - F.greatest(e["y0"], m["y0"]), F.lit(0.0))
        dx, dy = center(e, "x") - center(m, "x"), center(e, "y") - center(m, "y")
        holds = F.contains(e["text"], m["text"]) | F.contains(m["text"], e["text"])
        return ((w * h > 0) & (w * h > overlap * (area(e) + area(m) - w * h))) | (holds & (dx * dx + dy * dy < near * near))

    kept = F.aggregate(then, first, lambda acc, e: F.when(F.exists(acc, lambda m: same(e, m)), acc).otherwise(F.concat(acc, F.array(e))))
    ordered = F.sort_array(F.transform(kept, lambda e: F.struct(e["page"].alias("page"), e["y0"].alias("y0"), e["x0"].alias("x0"), e["pos"].alias("pos"), e["text"].alias("text"), e["y1"].alias("y1"), e["x1"].alias("x1"))))
    return both.select(*keys, F.posexplode(ordered).alias("place", "e")).select(*keys, "place", "e.*")


def merged_rows(tokens: DataFrame, keys: list[str], reach: float = 4.0, gap: float = 15.0, least: int = 10) -> DataFrame:
    """Boxes (keys, pos, x0, y0, x1, y1, text, score) joined to rows: keys, x0, y0, x1, y1, text, score, n_boxes.

    By center y, a box joins the first row whose mean center is within ``reach`` and one of whose boxes is at most ``gap`` to
    its side. Pages of fewer than ``least`` boxes stay as they are. Texts are joined by blanks from left to right; the score is the mean.
    """
    named = {"cy": (F.col("y0") + F.col("y1")) / 2, **{c: F.col(c) for c in ("pos", "x0", "x1", "y0", "y1", "text", "score")}}
    boxes = F.sort_array(F.collect_list(F.struct(*[c.alias(n) for n, c in named.items()]).cast(_BOX)))
    mean = lambda items: F.aggregate(items, F.lit(0.0), lambda s, i: s + i["cy"]) / F.size(items)
    row = lambda items: F.struct(mean(items).alias("cy"), items.alias("items"))

    def step(rows, box):
        beside = lambda i: F.greatest(box["x0"] - i["x1"], i["x0"] - box["x1"]) <= gap
        fits = F.transform(rows, lambda r: (F.abs(box["cy"] - r["cy"]) <= reach) & F.exists(r["items"], beside))
        grown = lambda at: F.transform(rows, lambda r, i: F.when(i + 1 == at, row(F.concat(r["items"], F.array(box)))).otherwise(r))
        return bound(F.array_position(fits, True), lambda at: F.when(at == 0, F.concat(rows, F.array(row(F.array(box))))).otherwise(grown(at)))

    start = F.array().cast(f"array<struct<cy:double,items:array<{_BOX}>>>")
    per = tokens.groupBy(*keys).agg(boxes.alias("_boxes"))
    rows = F.when(F.size("_boxes") < least, F.transform("_boxes", lambda b: row(F.array(b)))).otherwise(F.aggregate("_boxes", start, step))
    rows = per.select(*keys, F.explode(rows).alias("_row")).withColumn("_items", F.sort_array(F.transform("_row.items", lambda b: F.struct(b["x0"], b["cy"], b["pos"], b["text"].alias("text")))))
    of = lambda c: F.col(f"_row.items.{c}")
    score = F.aggregate(of("score"), F.lit(0.0), lambda s, x: s + x) / F.size(of("score"))
    return rows.select(
        *keys, F.array_min(of("x0")).alias("x0"), F.array_min(of("y0")).alias("y0"), F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"),
        F.array_join(F.col("_items.text"), " ").alias("text"), score.alias("score"), F.size(of("x0")).alias("n_boxes"),
    )


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _starred(line: Column) -> Column:
    good = lambda t: (F.length(t) >= 2) & t.rlike(CJK)
    coded = F.trim(F.regexp_extract(line, STAR_LINE, 1))
    plain = F.regexp_replace(F.regexp_extract(line, r"\*(\S+)", 1), r"^\*+|\*+$", "")
    return F.coalesce(F.when(good(coded), coded), F.when(good(plain), plain))


def _headed(line: Column, following: Column) -> Column:
    words = F.split(following, r"\s+")
    stops = F.array_position(F.transform(words, lambda w: w.rlike(r"^[\d.]+$") | w.rlike(f"^(?:{RATE})$") | w.rlike(r"^[\d,]+\.\d{2}$")), True).cast("int")
    lead = F.array_join(F.slice(words, F.lit(1), F.when(stops > 0, stops - 1).otherwise(F.size(words))), " ")
    name = F.trim(F.regexp_replace(F.trim(lead), r"^\*[^*]+\*", ""))
    return F.when(line.rlike("项目名称|服务名称") & following.rlike(r"\d+\.\d{2}") & (F.length(name) > 1), name)


def _goods(line: Column) -> Column:
    name = F.trim(F.regexp_extract(line, GOODS_LINE, 1))
    return F.when(~line.rlike(HEADER_LINE) & (F.length(name) > 1), name)


def _below(lines: Column, at: Column) -> Column:
    """Name from up to five lines below a header line: the data line without its numbers; lines that end in a bracket go on."""

    def step(state, line):
        parts, last = state["parts"], F.try_element_at(state["parts"], F.lit(-1))
        name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, RATE, ""), PRICE, ""), r"\b\d+\b", ""))
        named = (F.length(name) >= 2) & name.rlike(r"[\x{4e00}-\x{9fa5}a-zA-Z]")
        data = line.rlike(r"\d+\.\d{2}")
        goes_on = ~data & (F.trim(line) != "") & F.coalesce(last.rlike("[（(]$"), F.lit(False))
        more = F.when(data & named, F.concat(parts, F.array(name))).when(goes_on, F.concat(parts, F.array(F.trim(line)))).otherwise(parts)
        ends = state["done"] | (data & named & ~name.rlike("[）)]$"))
        return F.struct(F.when(state["done"], parts).otherwise(more).alias("parts"), ends.alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("done"))
    parts = F.aggregate(F.slice(lines, at + 2, F.lit(5)), start, step)["parts"]
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def project_name(lines: Column) -> Column:
    """Name of the goods in an array of lines, '' without one.

    By priority: a line with a *category* code, the line after one that names the project column, a goods label, the
    data lines below a line with amount and rate.
    """
    coded = _first(F.transform(lines, lambda line: F.when(F.contains(line, F.lit("*")), _starred(line))))
    headed = _first(F.transform(lines, lambda line, i: _headed(line, F.get(lines, i + 1))))
    goods = _first(F.transform(lines, _goods))
    below = _first(F.transform(lines, lambda line, i: F.when(F.contains(line, F.lit("金额")) & F.contains(line, F.lit("税率")), _below(lines, i))))
    return F.coalesce(coded, headed, goods, below, F.lit(""))
