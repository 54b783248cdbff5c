"""Queries over balanced headers, matches by place, cells, waiting lines, loads and parse results.

Where the tables lack a form (a missing part, a box, an anchor), every row gets one by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerweave.functions import money, repair, text
from ledgerweave.operators import cutover, documents, jobs, layout, matching, records, store
from ledgerweave.plans.catalog import register
from ledgerweave.session import shared_dir
from ledgerweave.sources.records import detected_type
from ledgerweave.sources.tables import table


def _case(number, *values):
    """The value at the number's remainder; values are columns."""
    out = None
    for i, v in enumerate(values):
        out = F.when(number % len(values) == i, v) if out is None else out.when(number % len(values) == i, v)
    return out


@register(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN -o_totalprice ELSE o_totalprice END AS t,
         CASE o_orderkey % 6 WHEN 0 THEN o_totalprice - 10 WHEN 1 THEN floor(o_totalprice / 2) WHEN 3 THEN floor(o_totalprice) - 100 WHEN 4 THEN 3 - o_totalprice WHEN 5 THEN o_totalprice END::DOUBLE AS n,
         CASE o_orderkey % 6 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 4 THEN -3 END::DOUBLE AS x FROM orders),
       p AS (SELECT *, coalesce(n, 0) AS nn, coalesce(x, 0) AS xx, abs(coalesce(n, 0) + coalesce(x, 0) - t) <= 0.02 OR abs(coalesce(n, 0) + coalesce(x, 0) - t) / greatest(abs(t), 1) <= 0.01 AS ok FROM o)
       SELECT o_orderkey, t AS total, round(CASE WHEN ok OR n IS NOT NULL OR round(t - xx, 2) <= 0 THEN n ELSE t - xx END, 2) AS net,
       round(CASE WHEN xx = 0 AND nn = t THEN 0 WHEN t < 0 AND nn < 0 AND xx <= 0 AND ok THEN x WHEN xx = 0 AND abs(nn - t) <= 0.02 THEN 0 WHEN ok THEN x
         WHEN n IS NOT NULL AND x IS NOT NULL THEN t - nn WHEN n IS NOT NULL AND round(t - nn, 2) > 0 THEN t - nn ELSE x END, 2) AS tax FROM p"""
)
def header_balance(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    none, number = F.lit(None).cast("double"), lambda v: F.lit(float(v))
    net = _case(k, t - 10, F.floor(t / 2).cast("double"), none, F.floor(t).cast("double") - 100, 3 - t, t)
    tax = _case(k, number(10), number(5), number(5), none, number(-3), none)
    r = repair.balanced_header(F.when(k % 6 == 4, -t).otherwise(t), net, tax)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.total", F.round("r.net", 2).alias("net"), F.round("r.tax", 2).alias("tax"))


@register(
    """WITH v AS (SELECT l_orderkey AS d, l_returnflag || '-' || l_partkey AS value, l_linenumber * 20.0::DOUBLE - 50 AS dx, l_quantity - 25 - l_orderkey % 20 AS dy FROM lineitem WHERE l_returnflag <> 'A'),
       f AS (SELECT *, sqrt(dx * dx + dy * dy) AS far, (CASE WHEN dx > 10 THEN 0.5 ELSE 0 END + CASE WHEN dy >= -10 AND dy <= 40 THEN 0.3 WHEN dy > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS way
         FROM v WHERE d IN (SELECT o_orderkey FROM orders)),
       s AS (SELECT *, 0.6::DOUBLE * (1 - far / 40) + 0.4::DOUBLE * way AS score FROM f WHERE far <= 40)
       SELECT d AS doc_id, 'total' AS label, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, far, value) AS k FROM s) WHERE k = 1"""
)
def nearest_values(spark, sf_dir):
    k = F.col("o_orderkey")
    labels = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("total").alias("label"), F.lit(50.0).alias("lx"), (25 + k % 20).cast("double").alias("ly"))
    values = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_returnflag", F.col("l_partkey").cast("string")).alias("value"), (F.col("l_linenumber") * 20.0).alias("vx"), F.col("l_quantity").alias("vy")
    )
    return matching.nearest_value(labels, values, 40.0, ("A-",)).withColumn("score", F.round("score", 6))


def _boxes(spark, sf_dir):
    """Lines of an order as boxes; their height differs by the part."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"),
        (n * 20).alias("x0"), (q * 2).alias("y0"), (n * 20 + 15).alias("x1"), (q * 2 + 6 + F.col("l_partkey") % 5).alias("y1"),
    )


_BOXES = """(SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, l_linenumber * 20.0::DOUBLE AS x0, l_quantity * 2 AS y0,
  l_linenumber * 20.0::DOUBLE + 15 AS x1, l_quantity * 2 + 6 + l_partkey % 5 AS y1 FROM lineitem)"""


@register(
    f"""WITH s AS (SELECT doc_id, pos AS field, owner, CASE WHEN abs((y0 + y1) / 2 - ac) < 100 THEN 0.4::DOUBLE * (1 - abs((y0 + y1) / 2 - ac) / 100) ELSE 0 END
         + CASE WHEN least(x1, b) - greatest(x0, a) > 0.5 * least(x1 - x0, b - a) THEN 0.3::DOUBLE ELSE 0 END AS score
         FROM {_BOXES}, (VALUES ('buyer', 0.0, 64.0, 20.0), ('seller', 64.0, 160.0, 90.0)) v(owner, a, b, ac))
        SELECT doc_id, field, CASE WHEN score > 0 THEN owner END AS owner, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, owner) AS k FROM s) WHERE k = 1"""
)
def field_owners(spark, sf_dir):
    fields = _boxes(spark, sf_dir).withColumnRenamed("pos", "field")
    sides = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(a).alias("x0"), F.lit(c - 10).alias("y0"), F.lit(b).alias("x1"), F.lit(c + 10).alias("y1")) for o, a, b, c in (("buyer", 0.0, 64.0, 20.0), ("seller", 64.0, 160.0, 90.0))])
    anchors = fields.select("doc_id").distinct().select("doc_id", F.inline(sides))
    return matching.owner_scores(fields, anchors).withColumn("score", F.round("score", 6))


@register(
    f"""WITH RECURSIVE t AS (SELECT doc_id, pos, (y0 + y1) / 2 AS c, y1 - y0 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, pos) AS k FROM {_BOXES}),
       f AS (SELECT doc_id, k, pos, c AS first, h AS fh, 0 AS "row" FROM t WHERE k = 1 UNION ALL
         SELECT t.doc_id, t.k, t.pos, CASE WHEN abs(c - first) < greatest(h, fh) * 0.6::DOUBLE THEN first ELSE c END, CASE WHEN abs(c - first) < greatest(h, fh) * 0.6::DOUBLE THEN fh ELSE h END,
           "row" + CASE WHEN abs(c - first) < greatest(h, fh) * 0.6::DOUBLE THEN 0 ELSE 1 END
         FROM f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1)
       SELECT doc_id, pos, "row" FROM f"""
)
def height_rows(spark, sf_dir):
    return layout.rows_by_heights(_boxes(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", "row")


@register(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 40 AS i, l_orderkey % 12 - 1 AS h, CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey % 12 + 5 + l_orderkey % 4 END AS s,
         CASE WHEN l_orderkey % 3 > 0 THEN 15 + l_orderkey % 13 END AS r, CASE WHEN l_orderkey % 7 > 0 THEN 24 + l_orderkey % 9 END AS f FROM lineitem),
       e AS (SELECT *, least(CASE WHEN f > s THEN f ELSE 40 END, CASE WHEN r > s THEN r ELSE 40 END, 40) AS s_end, least(r + 10, CASE WHEN f > r THEN f ELSE 40 END, 40) AS r_end FROM a)
       SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f IS NOT NULL AND i >= f THEN 'footer' WHEN s IS NOT NULL AND i >= s AND i < s_end THEN 'summary'
         WHEN h >= 0 AND i >= h - 7 AND i <= h THEN 'header' WHEN h >= 0 AND i > h AND i < coalesce(s, f, 40) THEN 'line_items' WHEN r IS NOT NULL AND i >= r AND i < r_end THEN 'remark' ELSE 'header' END AS region FROM e"""
)
def line_regions(spark, sf_dir):
    k = F.col("l_orderkey")
    region = layout.line_region(
        F.col("l_partkey") % 40, k % 12 - 1, F.when(k % 5 > 0, k % 12 + 5 + k % 4), F.when(k % 3 > 0, 15 + k % 13), F.when(k % 7 > 0, 24 + k % 9)
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", region.alias("region"))


@register(
    """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.5' WHEN 1 THEN '00' || o_orderkey WHEN 2 THEN 'n/a' WHEN 3 THEN '' ELSE o_orderkey || '.0' END AS t FROM orders),
       n AS (SELECT *, TRY_CAST(replace(t, ',', '') AS DOUBLE) AS n FROM c)
       SELECT o_orderkey, n AS amount, CASE WHEN n IS NULL AND t <> '' THEN t END AS amount_text, CASE WHEN n <> floor(n) THEN n END AS quantity, CASE WHEN (n IS NULL OR n = floor(n)) AND t <> '' THEN t END AS quantity_text FROM n"""
)
def number_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    t = _case(k, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5")), F.concat(F.lit("00"), k), F.lit("n/a"), F.lit(""), F.concat(k, F.lit(".0")))
    a, q = money.number_cell(t), money.quantity_cell(t)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", a["number"].alias("amount"), a["text"].alias("amount_text"), q["number"].alias("quantity"), q["text"].alias("quantity_text")
    )


@register(
    """WITH w AS (SELECT user_id, event_id, event_id % 10 = 0 AS urgent FROM events WHERE event_type NOT IN ('purchase', 'click'))
       SELECT user_id AS key, event_id AS pos, CASE WHEN urgent THEN 0 ELSE 1 END AS turn, CASE WHEN urgent THEN -event_id ELSE event_id END AS place
       FROM w WHERE urgent OR user_id NOT IN (SELECT user_id FROM w WHERE urgent)"""
)
def waiting_line(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing")
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("event_id") % 10 == 0).alias("urgent"), state.alias("state"))
    return jobs.pending_items(items).select("key", "pos", "turn", "place")


@register(
    """WITH l AS (SELECT user_id + 1 AS id, {'t': ts, 'e': event_id % 1000} AS pos, event_id % 4 AS op, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(event_id AS VARCHAR) AS v FROM events),
       s AS (SELECT id, max(CAST(op = 0 AS INT)) AS renewed, (arg_max({'v': v}, pos) FILTER (WHERE op < 2)).v AS v, (arg_max({'at': CASE WHEN op = 2 THEN ts END}, pos) FILTER (WHERE op <> 1)).at AS deleted_at, count(*) AS n FROM l GROUP BY 1)
       SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN coalesce(renewed, 0) = 0 THEN c_name END AS name, v AS value, deleted_at, 1 + coalesce(n, 0) AS n_ops FROM customer LEFT JOIN s ON s.id = c_custkey"""
)
def store_load(spark, sf_dir):
    snapshot = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name")).alias("data"))
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.get(F.array(*[F.lit(x) for x in ("upsert", "update", "soft_delete", "restore")]), (F.col("event_id") % 4).cast("int")).alias("op"),
        (F.col("user_id") + 1).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.create_map(F.lit("value"), F.col("event_id").cast("string")).alias("data"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("pos"),
    )
    return store.load_records(snapshot, log).select("id", F.col("data")["name"].alias("name"), F.col("data")["value"].alias("value"), "deleted_at", "n_ops")


_OPS = ("upsert", "upsert", "update", "update", "update", "update", "soft_delete", "soft_delete", "restore", "restore", "hard_delete", "update")


@register(
    f"""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) * 1000 + event_id % 1000 AS pos, {list(_OPS)}[event_id % 12 + 1] AS op, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(event_id AS VARCHAR) AS v FROM events),
       m AS (SELECT *, CASE op WHEN 'upsert' THEN 1 WHEN 'hard_delete' THEN 0 END AS mark FROM l),
       a AS (SELECT *, op = 'upsert' OR coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS live FROM m)
       SELECT id, arg_max(v, pos) FILTER (WHERE op IN ('upsert', 'update')) AS value, (arg_max({{'at': CASE WHEN op = 'soft_delete' THEN ts END}}, pos) FILTER (WHERE op <> 'update')).at AS deleted_at
       FROM a WHERE live GROUP BY 1 HAVING arg_max(op, pos) FILTER (WHERE mark IS NOT NULL) = 'upsert'"""
)
def store_cutover(spark, sf_dir):
    """Log, compact, log, compact, log, load: the same as one fold of the whole log."""
    pos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    log = table(spark, sf_dir, "events").select(
        F.get(F.array(*map(F.lit, _OPS)), (F.col("event_id") % 12).cast("int")).alias("op"), F.col("user_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.create_map(F.lit("value"), F.col("event_id").cast("string")).alias("data"), pos.alias("pos"),
    )
    first, second = log.approxQuantile("pos", [0.4, 0.7], 0.01)
    folder = f"{shared_dir(spark)}/ledgerweave/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    bounds = (log.where(F.col("pos") <= first), log.where((F.col("pos") > first) & (F.col("pos") <= second)), log.where(F.col("pos") > second))
    for batch, part in enumerate(bounds):
        cutover.append(part, f"{folder}/log", batch)
        if batch < 2:
            cutover.compact(spark, f"{folder}/versions", f"{folder}/log")
    state = cutover.load(spark, f"{folder}/versions", f"{folder}/log").where(~F.col("hard_deleted"))
    return state.select("id", F.col("data")["value"].alias("value"), "deleted_at")


@register("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def referenced_documents(spark, sf_dir):
    return documents.referenced(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"))


@register(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 80 AS n, o_custkey % 30 AS r, CASE o_orderkey % 4 WHEN 0 THEN '发票号码 金额' WHEN 1 THEN '购 买' || chr(10) || '方 大写' WHEN 2 THEN 'plain text' ELSE '单价 号码' END AS t FROM orders)
       SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS INT) AS score, n < 40 OR r > 0.5 * n OR o_orderkey % 4 > 0 AS weak FROM t"""
)
def text_layers(spark, sf_dir):
    k = F.col("o_orderkey")
    t = _case(k, *[F.lit(x) for x in ("发票号码 金额", "购 买\n方 大写", "plain text", "单价 号码")])
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.text_score(t).alias("score"), documents.weak_layer(k % 80, F.col("o_custkey") % 30, t).alias("weak"))


@register(
    """WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '未知号码' WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ELSE '' END AS number,
         CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS amount, CASE WHEN o_orderkey % 5 > 0 THEN '2024-01-01' ELSE '' END AS date FROM orders)
       SELECT k AS o_orderkey, concat_ws(',', CASE WHEN k % 3 <> 1 THEN 'invoiceNumber' END, CASE WHEN amount = '' THEN 'amount' END, CASE WHEN date = '' THEN 'invoiceDate' END) AS failed,
       '专票_' || CASE WHEN k % 3 = 1 THEN number ELSE '未知' END || '_' || CASE WHEN amount = '' THEN '0' ELSE amount END || CASE WHEN k % 2 = 0 THEN '.png' ELSE '.pdf' END AS new_name,
       CAST(least(2000, 10 * (k % 300)) AS INT) AS n_text, CAST(least(50, 1 + k % 60) AS INT) AS n_items, CAST(least(200, 1 + k % 300) AS INT) AS n_boxes FROM f"""
)
def responses(spark, sf_dir):
    k, empty = F.col("o_orderkey"), F.lit("")
    fields = {
        "type": F.lit("专票"), "number": _case(k, F.lit("未知号码"), F.lpad(k.cast("string"), 8, "0"), empty),
        "amount": F.when(k % 4 > 0, F.col("o_custkey").cast("string")), "date": F.when(k % 5 > 0, "2024-01-01"),
    }
    upto = lambda n: F.sequence(F.lit(0), (k % n).cast("int"))
    r = records.response(fields, F.repeat(F.lit("0123456789"), (k % 300).cast("int")), upto(60), upto(300), F.when(k % 2 == 0, "a.b.png").otherwise("scan"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select(
        "o_orderkey", F.concat_ws(",", "r.failed_fields").alias("failed"), "r.new_name", F.length("r.raw_text").alias("n_text"),
        F.size("r.line_items").alias("n_items"), F.size("r.bbox_data").alias("n_boxes"),
    )


@register(
    """WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.PNG' WHEN 2 THEN 'c.x.ofd' WHEN 3 THEN 'd' WHEN 4 THEN 'e.xml' WHEN 5 THEN 'f.jpeg' WHEN 6 THEN 'g.docx' ELSE '' END AS n,
         CASE o_orderkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ofd' WHEN 2 THEN 'image' ELSE '' END AS magic FROM orders),
       e AS (SELECT *, CASE k % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'ofd' WHEN 4 THEN 'xml' WHEN 5 THEN 'jpeg' WHEN 6 THEN 'docx' ELSE '' END AS ext FROM f)
       SELECT k AS o_orderkey, ext AS extension, CASE WHEN ext = 'ofd' THEN 'ofd' WHEN ext IN ('png', 'jpeg') THEN 'image' ELSE 'pdf' END AS format,
       CASE ext WHEN 'ofd' THEN 'application/ofd' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/pdf' END AS media,
       CASE WHEN magic <> '' THEN magic WHEN ext IN ('pdf', 'ofd', 'xml') THEN ext WHEN ext IN ('png', 'jpeg') THEN 'image' ELSE 'unknown' END AS kind FROM e"""
)
def file_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    name = _case(k, *[F.lit(n) for n in ("a.pdf", "b.PNG", "c.x.ofd", "d", "e.xml", "f.jpeg", "g.docx", "")])
    body = F.unhex(_case(k, *[F.lit(h) for h in ("255044462D", "504B030414", "FFD8FFE0", "00", "2550")]))
    ext = text.extension(name)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ext.alias("extension"), text.file_format(name).alias("format"), text.media_type(ext).alias("media"), detected_type(body, name).alias("kind")
    )
