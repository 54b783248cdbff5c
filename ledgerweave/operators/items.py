"""The item area of a document of lines: columns, header search, end of the items, keyed rows.

Lines are numbered from 0 per document. Windows run over one document; only the few lines before its first item, and the few cells of a row,
are gathered in one array.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.layout import bucket_of, gap_clusters

#: Patterns of the eight header cells in their order, begin of an item, words that end the items.
HEADER_PATTERNS = (
    "项目名称|货物或应税劳务、服务名称|货物.*名称|服务名称|品名",
    "规格型号|规格",
    r"单\s*位",
    r"数\s*量",
    r"单\s*价",
    r"金\s*额",
    r"税率\s*/\s*征收率|税率|征收率",
    r"税\s*额",
)
ITEM_START = r"^\*[^*]+\*"
DIGIT = r"\p{Nd}"
END_WORDS = ("合计", "价税合计", "小计", "大写", "小写", "收款人", "复核人", "开票人")
#: The eight columns, and what a header cell may be called.
COLUMNS = ("项目名称", "规格型号", "单位", "数量", "单价", "金额", "税率/征收率", "税额")
HEADER_NAMES = {
    "项目名称": "项目名称", "货物或应税劳务、服务名称": "项目名称", "货物或应税劳务名称": "项目名称", "服务名称": "项目名称", "货物名称": "项目名称",
    "品名": "项目名称", "商品名称": "项目名称", "规格型号": "规格型号", "规格": "规格型号", "单位": "单位", "数量": "数量", "单价": "单价", "金额": "金额",
    "税率": "税率/征收率", "征收率": "税率/征收率", "税额": "税额",
}


def is_item(text: Column) -> Column:
    """A line that begins with *code* and has a digit."""
    return F.coalesce(text.rlike(ITEM_START) & text.rlike(DIGIT), F.lit(False))


def column_bounds(lines: DataFrame, doc: str = "doc_id", x: str = "cx", eps: float = 14.0) -> DataFrame:
    """doc, bounds: midpoints between the mean x of neighbouring clusters; empty for a document of one cluster."""
    centers = gap_clusters(lines.where(F.col(x).isNotNull()), [doc], x, eps).groupBy(doc, "cluster").agg(F.avg(x).alias("_center"))
    # One array of centers per document, as long as its bounds.
    middles = lambda cs: F.transform(F.slice(cs, F.lit(1), F.size(cs) - 1), lambda c, i: (c + F.get(cs, i + 1)) / 2)
    return centers.groupBy(doc).agg(F.sort_array(F.collect_list("_center")).alias("_centers")).select(doc, middles(F.col("_centers")).alias("bounds"))


def even_bounds(left: Column, right: Column, columns: int = 8) -> Column:
    """Inner bounds of ``columns`` columns of one width, for a page without a usable header."""
    return F.transform(F.sequence(F.lit(1), F.lit(columns - 1)), lambda i: left + (right - left) * i / columns)


def header_ranges(lines: DataFrame, bounds: DataFrame | None = None, doc: str = "doc_id", window: int = 10, least: int = 3, tolerance: float = 5.0) -> DataFrame:
    """doc, header_first, header_last: the header's lines among the ``window`` lines before the first item.

    Every header pattern that a line holds is a hit. Hits, by y, form groups around the first one of each; a group counts with
    ``least`` different patterns whose order, from left to right, has one inversion at most. A document without a header has no row.
    ``lines``: doc, line, text, cx, cy; ``bounds``: doc, bounds (without them the order isn't looked at).
    """
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in enumerate(HEADER_PATTERNS)]))
    # Only items and lines with a hit travel, without their texts.
    marked = lines.select(doc, "line", "cx", "cy", found.alias("_found"), is_item(F.col("text")).alias("_item")).where(F.col("_item") | (F.size("_found") > 0))
    marked = marked.withColumn("_first", F.min(F.when(F.col("_item"), F.col("line"))).over(Window.partitionBy(doc)))
    near = marked.where((F.col("line") < F.col("_first")) & (F.col("line") >= F.col("_first") - window) & F.col(doc).isNotNull())
    hits = near.select(doc, "line", "cx", "cy", F.explode("_found").alias("pattern"))
    if bounds is None:
        hits = hits.withColumn("col", F.lit(-1))
    else:
        hits = hits.join(bounds, doc, "left").withColumn("col", F.when(F.size("bounds") > 0, bucket_of(F.col("cx"), F.col("bounds"))).otherwise(-1)).drop("bounds")
    # At most ``window`` lines with eight hits each.
    ordered = hits.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("cy", "line", "pattern", "col"))).alias("_hits"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(acc, hit):
        fresh = acc["y"].isNull() | (F.abs(hit["cy"] - acc["y"]) > tolerance)
        group = F.when(fresh, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.when(fresh, hit["cy"].cast("double")).otherwise(acc["y"]).alias("y"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    ordered = ordered.withColumn("_groups", F.aggregate("_hits", start, step)["groups"])
    rows = ordered.select(doc, F.posexplode("_hits").alias("place", "hit"), "_groups").select(doc, "place", F.get("_groups", F.col("place")).alias("group"), "hit.*")
    groups = rows.groupBy(doc, "group").agg(
        F.count_distinct("pattern").alias("patterns"), F.min("line").alias("lo"), F.max("line").alias("hi"),
        F.sort_array(F.collect_list(F.when(F.col("col") >= 0, F.struct("col", "place", "pattern")))).alias("order"),
    )
    at = lambda i: F.get("order", i)["pattern"]
    inversions = F.size(F.filter(F.transform("order", lambda x, i: at(i) > at(i + 1)), lambda x: x))
    good = groups.where((F.col("patterns") >= least) & (inversions <= 1))
    return good.groupBy(doc).agg(F.min("lo").alias("header_first"), F.max("hi").alias("header_last"))


def item_ends(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, last_item, item_end, ended_by: the last line of the items of every document that has some.

    1. ``blank``: before the first two blank lines in a row after the last item. 2. ``total``: above the total, whose y is that of the first line with two
    yen signs, else of the first 合计, or 合 with 计 at its height within four lines. 3. ``word``: before the first line with a word that ends the
    items; ``plain``: before two lines without item or digit; whichever comes first. 4. ``last``: the last line.
    ``lines``: doc, line, text, y0, y1.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"^\s+|\s+$", "")
    item = is_item(F.col("text"))
    over = Window.partitionBy(doc).orderBy("line")
    whole = Window.partitionBy(doc)
    rows = lines.select(doc, "line", text.alias("text"), "y0", ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.max(F.when(item, F.col("line"))).over(whole).alias("last_item")).where("last_item is not null")
    after = F.col("line") > F.col("last_item")
    blank = after & (F.col("text") == "")
    # As the search for words does, an item here needs no digit.
    plain = after & ~F.col("text").rlike(ITEM_START) & ~F.col("text").rlike(DIGIT)
    word = after & F.col("text").rlike("|".join(END_WORDS))
    follower = [(F.lead("text", k).over(over), F.lead("cy", k).over(over), F.lead("y0", k).over(over)) for k in range(1, 5)]
    split = F.coalesce(*[F.when((t == "计") & (F.abs(F.col("cy") - c) <= 3), F.least("y0", y)) for t, c, y in follower])
    total = F.when(F.col("text") == "合", split).when(F.col("text").contains("合计"), F.col("y0"))
    yen = F.length(F.regexp_replace("text", "[^¥￥]", "")) >= 2
    marked = rows.select(
        doc, "line", "y0", "last_item", F.when(blank & F.lag(blank).over(over), F.col("line")).alias("blank"), F.when(yen, F.col("y0")).alias("yen"), total.alias("total"),
        F.when(word, F.col("line")).alias("word"), F.when(plain & F.lag(plain).over(over), F.col("line")).alias("plain"),
    )
    facts = marked.groupBy(doc).agg(
        F.first("last_item").alias("last_item"), F.max("line").alias("last"), F.min("blank").alias("blank"), F.min("word").alias("word"), F.min("plain").alias("plain"),
        F.coalesce(F.min_by("yen", F.when(F.col("yen").isNotNull(), F.col("line"))), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("line")))).alias("total"),
    )
    below = marked.join(facts.where("blank is null and total is not null").select(doc, F.col("total").alias("_total")), doc)
    below = below.where((F.col("line") >= F.col("last_item")) & (F.col("y0") >= F.col("_total") - 1)).groupBy(doc).agg(F.min("line").alias("below"))
    out = facts.join(below, doc, "left")
    words_first = F.col("word").isNotNull() & (F.col("plain").isNull() | (F.col("word") <= F.col("plain")))
    by = (
        F.when(F.col("blank").isNotNull(), "blank").when(F.col("total").isNotNull(), F.when(F.col("below").isNotNull(), "total").otherwise("last"))
        .when(words_first, "word").when(F.col("plain").isNotNull(), "plain").otherwise("last")
    )
    out = out.withColumn("ended_by", by)
    kind = F.col("ended_by")
    end = (
        F.when(kind == "blank", F.greatest(F.col("blank") - 2, F.col("last_item"))).when(kind == "total", F.greatest(F.col("below") - 1, F.col("last_item")))
        .when(kind == "word", F.col("word") - 1).when(kind == "plain", F.col("plain") - 2).otherwise(F.col("last"))
    )
    return out.select(doc, "last_item", end.alias("item_end"), "ended_by")


def header_name(cell: Column) -> Column:
    """A header cell's own name, or the column it is another name of."""
    names = F.create_map(*[F.lit(x) for pair in HEADER_NAMES.items() for x in pair])
    return F.coalesce(F.get(F.array(names[F.trim(cell)]), F.lit(0)), F.trim(cell))


def keyed_rows(cells: DataFrame, headers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, row, fields (map of header to text): the rows of a grid under their headers.

    A table of five to seven columns without 规格型号 and 单位 but with five of the other six columns gets the eight columns; headers that are empty in all rows of a document leave;
    names lose their blanks. ``cells``: doc, row, col, text, one cell a place; ``headers``: doc, headers (array; of
equal ones the first counts).
    """
    rows = cells.groupBy(doc, "row").agg(F.collect_list(F.struct("col", "text")).alias("cells"))
    return keyed_whole_rows(rows, headers, doc)


def keyed_whole_rows(rows: DataFrame, headers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``keyed_rows`` of rows that come whole: doc, row, cells (array of col, text)."""
    names = headers.select(doc, F.transform("headers", header_name).alias("_h"))
    six = [c for c in COLUMNS if c not in ("规格型号", "单位")]
    has = lambda c: F.array_contains("_h", F.lit(c))
    known = sum((has(c).cast("int") for c in six), F.lit(0))
    short = ~has("规格型号") & ~has("单位") & F.size("_h").between(5, 7) & (known >= 5)
    target = F.when(short, F.lit(list(COLUMNS))).otherwise(F.array_distinct("_h"))
    # A header's place is looked up once a document, not once a row.
    names = names.select(doc, F.transform(target, lambda h: F.struct(h.alias("name"), (F.array_position("_h", h) - 1).cast("int").alias("at"))).alias("_target"))
    rows = rows.select(doc, "row", F.col("cells").alias("_list"))
    # Which columns are filled comes from the cells of a document before any field is made; a name must hold more than white space of any kind.
    whole = Window.partitionBy(doc)
    places = lambda test: F.flatten(F.collect_set(F.transform(F.filter("_list", lambda x: test(x["text"])), lambda x: x["col"])).over(whole))
    rows = rows.withColumns({"_filled": places(lambda t: F.trim(t) != ""), "_named": places(lambda t: t.rlike(r"\S"))}).join(names, doc)
    rows = rows.withColumn("_cells", F.map_from_entries("_list"))
    text = lambda h: F.trim(F.coalesce(F.try_element_at("_cells", h["at"]), F.lit("")))
    entry = lambda h: F.struct(h["name"].alias("key"), F.when(h["name"] == "项目名称", F.regexp_replace(text(h), r"\s+", "")).otherwise(text(h)).alias("value"))
    filled = lambda h: F.array_contains(F.when(h["name"] == "项目名称", F.col("_named")).otherwise(F.col("_filled")), h["at"])
    return rows.select(doc, "row", F.map_from_entries(F.transform(F.filter("_target", filled), entry)).alias("fields"))


#: What marks the places of a page; of the first two a token that is such a text goes before one that holds it.
ANCHORS = {
    "buyer": (True, ("购买方信息", "购方信息", "购买方", "购方")),
    "seller": (True, ("销售方信息", "销方信息", "销售方", "销方")),
    "header": (False, ("项目名称", "货物或应税劳务.*名称", "服务.*名称")),
    "summary": (False, ("价税合计", "合计")),
    "remark": (False, ("^备注$", "^备注：", "^备注:")),
    "footer": (False, ("收款人", "复核人", "开票人")),
}


def anchors(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, anchor, text, pos: the token that marks each place, the first one of its kind. ``tokens``: doc, pos, text."""
    tests = []
    for name, (whole_first, patterns) in ANCHORS.items():
        holds = F.col("text").rlike("|".join(f"(?:{p})" for p in patterns))
        whole = F.col("text").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if whole_first else F.lit(True)
        tests.append(F.when(holds, F.struct(F.lit(name).alias("anchor"), (~whole).alias("part"))))
    rows = tokens.select(doc, "pos", "text", F.explode(F.array_compact(F.array(*tests))).alias("a"))
    best = F.min_by(F.struct("text", "pos"), F.struct("a.part", "pos")).alias("b")
    return rows.groupBy(doc, F.col("a.anchor").alias("anchor")).agg(best).select(doc, "anchor", "b.text", "b.pos")


def carried_orphans(lines: DataFrame, data: Column, noise: Column, starts: Column, name_only: Column, most: int = 4, doc: str = "doc_id") -> DataFrame:
    """doc, line, text: lines without data joined with the data line they belong to.

    An orphan (neither data nor noise) waits for the next data line and goes before it, the last ``most`` of those waiting. A line that ``starts`` an item after
    some data line sends those waiting to the end of the last data line. What waits at the end goes there too, if it is only a name; without
    any data line the orphans stay lines of their own. ``lines``: doc, line, text. A task streams through sorted lines with the lines of one item as its state.
    """
    flags = [F.coalesce(c, F.lit(False)) for c in (data, ~F.coalesce(data, F.lit(False)) & ~F.coalesce(noise, F.lit(False)), starts, name_only)]
    kind = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags)), F.lit(0))
    # Noise that starts no item changes nothing.
    rows = lines.select(doc, "line", "text", kind.alias("_kind")).where(F.col("_kind").bitwiseAND(7) > 0)

    def run(batches):
        key, last, owned, waiting = (), None, [], []

        def closed():
            """What the document before still holds, of its last data line or of orphans alone."""
            if last is not None:
                yield (*key, last, owned + [t for _, t, name in waiting if name])
            elif most > 0:
                yield from ((*key, line, [t]) for line, t, _ in waiting)

        for batch in batches:
            out = []
            for d, line, text, k in zip(*[c.to_pylist() for c in batch.columns]):
                if (d,) != key:
                    out += closed()
                    key, last, owned, waiting = (d,), None, [], []
                if k & 4 and last is not None:
                    owned += [t for _, t, _ in waiting]
                    waiting = []
                if k & 1:
                    if last is not None:
                        out.append((*key, last, owned))
                    last, owned, waiting = line, [t for _, t, _ in waiting[max(len(waiting) - most, 0) :]] + [text], []
                elif k & 2:
                    waiting.append((line, text, bool(k & 8)))
            yield _joined(batch, out)
        if key:
            yield _joined(batch, list(closed()))

    return rows.repartition(doc).sortWithinPartitions(doc, "line").mapInArrow(run, rows.select(doc, "line", "text").schema)


def _joined(batch, out: list) -> pa.RecordBatch:
    """doc, line and the texts that are not null with a blank between them, in the types of ``batch``."""
    ids, lines, texts = zip(*out) if out else ((), (), ())
    kinds = batch.schema
    joined = [" ".join(t for t in ts if t is not None) for ts in texts]
    return pa.RecordBatch.from_arrays([pa.array(ids, kinds.field(0).type), pa.array(lines, kinds.field(1).type), pa.array(joined, kinds.field(2).type)], names=kinds.names[:3])
