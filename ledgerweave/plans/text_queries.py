"""Queries over cleaned texts, checks and document facts.

The tables hold no invoices in Chinese, so these queries write such texts around the columns of every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import checks, cleaning, dates, hashes, money
from ledgerweave.operators import documents, matching, search
from ledgerweave.plans.catalog import register
from ledgerweave.sources.tables import table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(number, *values):
    """The value at the number's remainder."""
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


@register(
    """SELECT o_orderkey, '甲' || o_orderkey || '公司' AS party, CASE o_orderkey % 4 WHEN 0 THEN '张三' ELSE '' END AS person,
       CASE o_orderkey % 2 WHEN 0 THEN '' ELSE 'n ' || o_orderkey END AS note FROM orders"""
)
def cleaned_parties(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = _text("[BUYER_START] 甲", k, "　公司", _pick(k, " 下载次数:3 页", "纳税人识别号:123", " 销 ：乙", "__AUX_a1__", "购 名 称:丙 项目名称"))
    person = _pick(k, " __AUX_1__ 张三 ", "合计", "[SELLER_END]金额12", "一二三四五六七八九十甲乙丙")
    note = F.when(k % 2 == 0, "BUYER_END").otherwise(_text("n \n[SELLER_START] ", k, " "))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", cleaning.party_name(raw).alias("party"), cleaning.person_name(person).alias("person"), cleaning.note_text(note).alias("note")
    )


@register(
    """SELECT o_orderkey, '发票号码:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || chr(10) || '日期 ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || '¥' || o_custkey || '05.' || o_orderkey % 9 || '0' ||
       chr(10) || '纳税人识别号:9A0' || o_custkey || 'X' AS text FROM orders"""
)
def ocr_digits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = _text(
        "发票号码: ", F.translate(F.lpad(k.cast("string"), 8, "0"), "01", "OI"), "\n日期 ", F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd"), "-0", "-O"),
        "\n¥", F.col("o_custkey"), "O5.", k % 9, "O\n纳税人识别号: 9ao", F.translate(F.col("o_custkey").cast("string"), "0", "O"), "x",
    )
    return o.select("o_orderkey", cleaning.ocr_fixed(raw).alias("text"))


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '8col' WHEN 1 THEN '6col' ELSE 'unknown' END AS kind FROM orders")
def header_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    header = _pick(k, "项目名称 规格型号 单位 数量 单价 金额 税率 税额", "项目 名称\n单价\t数量 金额 税率 税额", "项目名称 数量 单价 金额 税率 税额", "项目 金额")
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.column_format(header).alias("kind"))


@register("SELECT o_orderkey, '息|纳税人识别号：|纳税人识别号：' || o_orderkey || '|息方纳税人识别号:|' || o_orderkey AS lines FROM orders")
def label_splits(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = F.array(_text(" 息纳税人识别号：", k), _text("纳税人识别号：", k), F.lit("息方纳税人识别号:"), k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(cleaning.split_labels(lines), "|").alias("lines"))


@register(
    """SELECT event_id, epoch(date_trunc('second', ts)) - CASE event_id % 3 WHEN 0 THEN 0 ELSE 28800 END AS seconds FROM events"""
)
def beijing_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    return e.select("event_id", dates.beijing_seconds(F.concat("t", _pick(F.col("event_id"), "Z", "+05:30", ""))).alias("seconds"))


@register(
    """SELECT o_orderkey, strftime(o_orderdate, '%m月%d日') AS short, strftime(o_orderdate, '%Y年%m月%d日') AS other,
       CASE o_orderkey % 3 WHEN 0 THEN 'a_' ELSE '' END || strftime(o_orderdate, '%Y%m%d') || '.7z' AS archive FROM orders"""
)
def date_names(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    archive = cleaning.archive_name(_pick(F.col("o_orderkey"), "a", " ", ""), dates.date_in_format(day, "YYYYMMDD"), "7Z")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_in_format(day, "MM月DD日").alias("short"), dates.date_in_format(day, "none").alias("other"), archive.alias("archive"))


@register(
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 3 = 0 THEN 'same_party' END, CASE WHEN o_orderkey % 2 = 0 THEN 'tax_is_number' END,
         CASE WHEN o_orderkey % 5 = 0 THEN 'number_format' END, CASE WHEN o_custkey % 2 = 0 THEN 'same_people' END) AS warnings,
       least(0.9, CASE WHEN o_orderkey % 2 = 0 THEN 0.4 ELSE 0.9 END, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0.9 END)::DOUBLE AS number,
       (CASE WHEN o_custkey % 3 = 0 THEN 0.5 ELSE 0.8 END)::DOUBLE AS buyer, (CASE WHEN o_custkey % 3 = 0 THEN 0.3 ELSE 0.3 END)::DOUBLE AS seller FROM orders"""
)
def field_clashes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = _text(F.when(k % 5 == 0, "N").otherwise(""), F.lpad(k.cast("string"), 9, "0"))
    found = checks.field_clashes(
        number, (F.lit("甲"), F.when(c % 3 == 0, "甲").otherwise("乙")), (F.lit(""), F.when(k % 2 == 0, number)),
        (F.lit("张"), F.lit(""), F.when(c % 2 == 0, "张").otherwise("李")), F.lit(0.9), (F.lit(None).cast("double"), F.lit(0.3)),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", F.array_join("f.warnings", ",").alias("warnings"), "f.number", "f.buyer", "f.seller")


@register("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM orders")
def words_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    words = money.words_to_amount(_pick(k, "壹佰贰拾元伍角", "壹佰元整", "贰佰元整"))
    total = F.when(k % 3 == 0, -120.1).when(k % 3 == 1, 101.0).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.words_checked(words, total, F.lit(None).cast("double")).alias("confidence"))


@register(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'tax_id' WHEN 2 THEN 'address' ELSE 'bank' END AS best,
       round([0.75, 0.6, 0.6, 0.6][1 + o_orderkey % 4], 6)::DOUBLE AS company, round([0.0, 0.6, 1.0, 0.8][1 + o_orderkey % 4], 6)::DOUBLE AS address FROM orders"""
)
def layout_scores(spark, sf_dir):
    text = _pick(F.col("o_orderkey"), "甲乙有限公司", "91110000ABCDEFGH12", "海南省甲市乙区丙路12号楼阁", "工行支行账号账户1234567890")
    s = table(spark, sf_dir, "orders").select("o_orderkey", checks.layout_scores(text).alias("s"))
    return s.select("o_orderkey", "s.best", F.round("s.company", 6).alias("company"), F.round("s.address", 6).alias("address"))


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(0, least(100, 30 + CASE l_linenumber % 4 WHEN 0 THEN 25 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END
         + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 15 - CASE WHEN l_partkey % 2 = 0 THEN 15 ELSE 0 END END
         - CASE WHEN l_partkey % 3 = 0 THEN 30 ELSE 0 END - CASE WHEN l_partkey % 5 = 0 THEN 40 ELSE 0 END)) AS INT) AS score FROM lineitem"""
)
def candidate_scores(spark, sf_dir):
    p, no = F.col("l_partkey"), F.lit(False)
    source = _pick(F.col("l_linenumber"), "bbox_l1_label", "bbox_l2_anchor", "bbox_l3_region", "text_l4")
    score = checks.candidate_score(source, F.col("l_returnflag") != "R", F.lit(True), p % 2 == 0, no, p % 3 == 0, p % 5 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.cast("int").alias("score"))


@register(
    """SELECT l_orderkey AS doc_id, CASE WHEN 2 * count(*) FILTER (WHERE l_linenumber * 3 < 10 AND l_quantity >= 10) > count(*) THEN 'image' ELSE 'text' END AS kind FROM lineitem GROUP BY 1"""
)
def document_kinds(spark, sf_dir):
    page = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("repeat('x', int(l_linenumber * 3))").alias("text"), F.floor(F.col("l_quantity") / 10).alias("n_images"))
    return documents.document_kinds(page)


@register("SELECT doc_id, text IS NULL OR length(regexp_replace(text, '[\\n ]', '', 'g')) < 20 AS needs_ocr FROM documents")
def ocr_needs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", documents.needs_ocr(F.col("text")).alias("needs_ocr"))


@register(
    """SELECT o_orderkey, lower(printf('%032x', o_orderkey)) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey ELSE '0000000000000001' || lower(printf('%016x', o_orderkey)) END AS other FROM orders"""
)
def legacy_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    other = F.when(k % 2 == 0, _text("x", k)).otherwise((F.lit("18446744073709551616").cast("decimal(30,0)") + k).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", hashes.hex_id(k.cast("string")).alias("id"), hashes.hex_id(other).alias("other"))


@register(
    """SELECT doc_id, left(md5(doc_id || '|' || source || '|' || lang || '|v1|hl:'), 16) AS etag, doc_id || '|' || source || '|1' || CASE WHEN lang = 'en' THEN '' ELSE '|hl:' || lang END AS key FROM documents"""
)
def cache_names(spark, sf_dir):
    d, s, g = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    key = hashes.cache_key(d, s, F.lit(1), F.lit(""), F.when(g == "en", "").otherwise(g))
    return table(spark, sf_dir, "documents").select("doc_id", hashes.etag(d, s, g, F.lit("1"), F.lit("")).alias("etag"), key.alias("key"))


@register(
    """WITH RECURSIVE e AS (SELECT l_orderkey AS d, l_linenumber AS line, {'pos': l_linenumber * 1000000 + l_partkey, 'text': l_returnflag || CASE WHEN l_partkey % 2 = 0 THEN l_linestatus ELSE '' END,
           'x0': l_linenumber * 6.0, 'y0': l_quantity, 'x1': l_linenumber * 6.0 + 20, 'y1': l_quantity + 10} AS b FROM lineitem),
       known AS (SELECT d, list(b ORDER BY b.pos) FILTER (WHERE line % 2 = 1) AS b FROM e GROUP BY d),
       found AS (SELECT d, b, row_number() OVER (PARTITION BY d ORDER BY b.pos, b.text, b.x0, b.y0) AS k FROM e WHERE line % 2 = 0),
       f AS (SELECT d, 0::BIGINT AS k, coalesce(b, []) AS kept FROM known UNION ALL
         SELECT f.d, n.k, CASE WHEN len([m FOR m IN f.kept IF
             (greatest(least(m.x1, n.b.x1) - greatest(m.x0, n.b.x0), 0) * greatest(least(m.y1, n.b.y1) - greatest(m.y0, n.b.y0), 0)) > 0.5 * (400 -
              (greatest(least(m.x1, n.b.x1) - greatest(m.x0, n.b.x0), 0) * greatest(least(m.y1, n.b.y1) - greatest(m.y0, n.b.y0), 0)))
             OR ((contains(m.text, n.b.text) OR contains(n.b.text, m.text)) AND (m.x0 - n.b.x0) * (m.x0 - n.b.x0) + (m.y0 - n.b.y0) * (m.y0 - n.b.y0) < 900)]) > 0
           THEN f.kept ELSE list_append(f.kept, n.b) END FROM f JOIN found n ON n.d = f.d AND n.k = f.k + 1)
       SELECT d AS doc_id, len(arg_max(kept, k)) AS n_kept, CAST(list_sum([m.pos FOR m IN arg_max(kept, k)]) AS BIGINT) AS pos_sum FROM f GROUP BY 1"""
)
def merged_elements(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_linenumber") * 6.0
    text = F.concat("l_returnflag", F.when(F.col("l_partkey") % 2 == 0, F.col("l_linestatus")).otherwise(""))
    e = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("pos"), F.lit(1).alias("page"), text.alias("text"),
        x.alias("x0"), F.col("l_quantity").cast("double").alias("y0"), (x + 20).alias("x1"), (F.col("l_quantity") + 10).cast("double").alias("y1"), "l_linenumber",
    )
    known, found = e.where("l_linenumber % 2 = 1").drop("l_linenumber"), e.where("l_linenumber % 2 = 0").drop("l_linenumber")
    out = documents.merged_elements(known, found, ["doc_id"])
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("pos").alias("pos_sum"))


@register()
def merged_rows(spark, sf_dir):
    """No SQL twin: the fold takes the mean of growing rows; the tests hold it against a plain loop."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_linenumber") * 12.0, F.col("l_quantity").cast("double")
    boxes = li.select(
        F.floor(F.col("l_orderkey") / 10).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"), x.alias("x0"), y.alias("y0"),
        (x + 8).alias("x1"), (y + 6).alias("y1"), F.col("l_returnflag").alias("text"), F.col("l_discount").cast("double").alias("score"),
    )
    return documents.merged_rows(boxes, ["page"])


@register(
    """WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CASE l_orderkey % 4 WHEN 3 THEN '1,000.00' WHEN 2 THEN CAST(CAST(t + 0.5 AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST(t AS DECIMAL(18,2)) AS VARCHAR) END AS amount FROM s"""
)
def amount_nets(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"))
    k = F.col("l_orderkey") % 4
    current = F.when(k == 0, "").when(k == 1, "x").when(k == 2, (F.col("t") + F.lit("0.5").cast("decimal(3,1)")).cast("decimal(18,2)").cast("string")).otherwise("1,000.00")
    return s.select("l_orderkey", checks.amount_or_sum(current, F.col("t"), F.lit("130"), F.lit("1130.01")).alias("amount"))


@register(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS p FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(q * p AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CASE WHEN l_linenumber % 3 < 2 THEN '13%' WHEN q * p > 0 THEN '13.00%' ELSE '' END AS rate, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(q * p * 0.13 AS DECIMAL(18,2)) AS VARCHAR) END AS tax FROM a"""
)
def derived_items(spark, sf_dir):
    q, p, k = F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long"), F.col("l_linenumber") % 3
    cents = lambda c: c.cast("decimal(18,2)").cast("string")
    # 0: the amount is missing, so no tax is derived; 1: amount and tax are wrong; 2: the rate is missing.
    amount = F.when(k == 0, "").when(k == 1, cents(q * p + 7)).otherwise(cents(q * p))
    rate = F.when(k == 2, "").otherwise("13%")
    tax = F.when(k == 1, "1").when(k == 2, cents(q * p * F.lit("0.13").cast("decimal(4,2)")))
    item = checks.derived_item(q.cast("string"), p.cast("string"), amount, rate, tax)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", item.alias("i")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "i.amount", F.coalesce("i.rate", F.lit("")).alias("rate"), F.coalesce("i.tax", F.lit("")).alias("tax")
    )


@register("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '20,40' WHEN 1 THEN '10,20,30,40' ELSE '10,20' END AS bounds FROM orders")
def merged_columns(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = [["项目", "名称", "规格型号", "规格", "税额"], ["单位", "数量", "x", "单价", "y"], ["单价", "金额"]]
    headers = F.get(F.array(*[F.array(*map(F.lit, p)) for p in pick]), (k % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(cleaning.merged_bounds(F.array(*map(F.lit, (10, 20, 30, 40))), headers), ",").alias("bounds"))


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, '*纸*A4纸|' || CAST(l_quantity AS BIGINT) || '|2024|-01|-02|91110000|ABCDEFGH12|0.12|34|¥' || l_partkey || '.50|13%' AS tokens, '运输服务' AS plain FROM lineitem"""
)
def item_tokens(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    line = _text(" *纸*A4纸 ", q, " 2024-01-02 91110000ABCDEFGH12 合计 甲乙丙有限公司 壹佰元 0.1234 ", F.lit("¥"), F.col("l_partkey"), ".50 123456789 13% ")
    joined = F.array_join(cleaning.item_tokens(line), "|")
    # The forms cut dates, ids and long decimals before they can be told as such; bar codes of 8 digits stay.
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", joined.alias("tokens"), F.array_join(cleaning.item_tokens(F.lit(" 运输服务 ")), "|").alias("plain"))


@register(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '*纸*笔' WHEN 1 THEN '甲 乙' WHEN 2 THEN '餐饮' WHEN 3 THEN '住宿) 费用' ELSE '' END AS name FROM orders"""
)
def project_names(spark, sf_dir):
    k = F.col("o_orderkey")
    number = k.cast("string")
    price = F.concat(number, F.lit(".50"))
    pages = [
        F.array(F.lit("发票"), F.lit("*纸*笔 12.50 13%")),
        F.array(F.lit("项目名称 金额"), F.lit("甲 乙 3 12.50 13%")),
        F.array(F.lit("货物或应税劳务: 餐饮 8"), F.lit("x")),
        F.array(F.lit("金额 税率"), _text("住宿) ", price, " 6%"), F.lit("续行"), _text("费用 ", price)),
        F.array(F.lit("发票"), number),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.project_name(F.get(F.array(*pages), (k % 5).cast("int"))).alias("name"))


@register("SELECT o_orderkey, o_orderkey || chr(10) || 'b' || chr(10) || 'a' AS text FROM orders")
def region_texts(spark, sf_dir):
    regions = F.create_map(F.lit("header"), F.array(F.lit("a")), F.lit("summary"), F.array(F.col("o_orderkey").cast("string"), F.lit("b")), F.lit("noise"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.region_text(regions, "summary", "noise", "footer", "header").alias("text"))


@register("SELECT o_orderkey, o_orderkey + 1.5 AS second, o_orderkey + 2.5 AS third, o_orderkey + 3.6 AS last FROM orders")
def char_places(spark, sf_dir):
    x0 = F.col("o_orderkey").cast("double")
    b = cleaning.char_boxes(F.lit("纸a. "), x0, x0 + 3.6)
    return table(spark, sf_dir, "orders").select("o_orderkey", b.alias("b")).select(
        "o_orderkey", F.round(F.get("b.x0", F.lit(1)), 6).alias("second"), F.round(F.get("b.x0", F.lit(2)), 6).alias("third"), F.round(F.get("b.x1", F.lit(3)), 6).alias("last")
    )


@register(
    """WITH a AS (SELECT l_orderkey AS d, l_extendedprice AS v, l_linenumber * 20.0 AS x, l_quantity AS y FROM lineitem),
       p AS (SELECT l.d, l.v AS net, r.v AS tax, r.x - l.x AS gap, l.x, l.y, (abs(l.y - 25) + 0.1 * abs(l.x - 50)) * CASE WHEN l.x > 50 THEN 0.8 ELSE 1 END AS c
         FROM a l JOIN a r ON l.d = r.d AND abs(l.y - r.y) <= 8 AND l.x < r.x AND l.v > r.v)
       SELECT d AS doc_id, net, tax, round(net + tax, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY c, gap, net, tax) AS k FROM p) WHERE k = 1"""
)
def pair_totals(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("amount"), (F.col("l_linenumber") * 20.0).alias("x"), F.col("l_quantity").alias("y"))
    anchors = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(50.0).alias("ax"), F.lit(25.0).alias("ay"))
    return matching.pair_at_anchor(matching.row_pairs(a), anchors).withColumn("total", F.round(F.col("net") + F.col("tax"), 2))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def incomplete_files(spark, sf_dir):
    k = F.col("o_orderkey")
    fields = F.when(k % 3 == 0, F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").where(search.is_incomplete(fields, F.when(k % 5 == 0, "数据缺失"))).select("o_orderkey")
