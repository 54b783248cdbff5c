"""Queries over invoice-shaped tables: search, lists, statistics, export and store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.functions import dates, hashes, money, repair, text
from ledgerweave.operators import export, extract, layout, matching, pages, search, stats, store
from ledgerweave.plans.catalog import register
from ledgerweave.sources.records import detected_type, xml_fields
from ledgerweave.sources.tables import invoices, table

_INV = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS number, o_orderpriority AS type,
  strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS amount, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS parse_ok,
  o_orderkey AS pos, o_custkey AS custkey FROM orders)"""


def _col(df, name):
    return df.withColumns({name: F.lit(None).cast("string"), "created_at": F.col("date")})


@register(
    """SELECT o_orderpriority AS type, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS parsed FROM orders GROUP BY 1 ORDER BY 3 DESC, 1"""
)
def stats_by_type(spark, sf_dir):
    return (
        invoices(spark, sf_dir)
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(stats.exact(F.col("amount"))).cast("double").alias("total"), F.sum("parse_ok").cast("long").alias("parsed"))
        .orderBy(F.desc("total"), "type")
    )


@register(
    f"""SELECT type, type IS NULL AS grand, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total,
        CAST(sum(parse_ok) AS BIGINT) AS ok, CAST(sum(1 - parse_ok) AS BIGINT) AS failed FROM {_INV} GROUP BY ROLLUP (type)"""
)
def stats_rollup(spark, sf_dir):
    return stats.statistics(invoices(spark, sf_dir)).withColumn("total", F.col("total").cast("double"))


@register(
    f"""SELECT number, date, amount FROM (SELECT i.*, c_name FROM {_INV} i JOIN customer ON c_custkey = custkey)
        WHERE type = '1-URGENT' AND date >= '1993-01-01' AND date <= '1997-12-31' AND contains(lower(number || ' ' || c_name || '   '), 'customer#')
        ORDER BY amount DESC, pos LIMIT 50 OFFSET 10"""
)
def search_page(spark, sf_dir):
    df = _col(invoices(spark, sf_dir), "deleted_at")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df = df.join(names, F.col("custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    df = df.withColumn("search_text", text.search_text(F.col("number"), F.col("c_name"), none, none, none))
    spec = search.SearchSpec("Customer#", "1-URGENT", "1993-01-01", "1997-12-31", "amount", "DESC", 50, 10)
    return search.search(df, spec)[0].select("number", "date", "amount")


@register(f"SELECT count(*) AS total FROM {_INV} WHERE type = '2-HIGH' AND date >= '1995-01-01'")
def search_total(spark, sf_dir):
    df = _col(invoices(spark, sf_dir), "deleted_at").withColumn("search_text", F.lit(""))
    return search.search(df, search.SearchSpec(type="2-HIGH", date_from="1995-01-01"))[1]


_FILES = """(SELECT doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS number,
  CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'parsed' END AS status, 'doc' || doc_id || '_p' || (doc_id % 3 + 1) || '.pdf' AS name FROM documents)"""


def _files(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("pos"),
        F.when(d % 11 == 0, "").otherwise(F.col("n_chars").cast("string")).alias("number"),
        F.when(d % 7 == 0, "error").otherwise("parsed").alias("status"),
        F.concat(F.lit("doc"), d.cast("string"), F.lit("_p"), (d % 3 + 1).cast("string"), F.lit(".pdf")).alias("name"),
    )


@register(
    f"""WITH p AS (SELECT * FROM {_FILES} WHERE status = 'parsed' AND number <> ''),
        g AS (SELECT number, count(*) AS total, min(pos) AS f FROM p GROUP BY 1 HAVING count(*) > 1),
        i AS (SELECT *, row_number() OVER (ORDER BY f) AS group_index FROM g)
        SELECT p.pos, p.number, i.total, CAST(i.group_index AS INT) AS group_index, p.pos = i.f AS is_first FROM p JOIN i ON p.number = i.number"""
)
def duplicate_groups(spark, sf_dir):
    return stats.duplicate_groups(_files(spark, sf_dir)).select("pos", "number", "total", "group_index", "is_first")


@register(
    f"""WITH f AS (SELECT *, pos % 13 = 0 AS prev FROM {_FILES})
        SELECT pos, name, CASE WHEN status = 'error' THEN 0 WHEN prev THEN 2 ELSE 3 END AS "partition" FROM f"""
)
def sort_partitions(spark, sf_dir):
    df = _files(spark, sf_dir).withColumns(
        {
            "failed": search.is_failed(F.col("status"), F.array().cast("array<string>"), F.lit("")),
            "duplicate_group": F.lit(None).cast("int"),
            "previous_year": F.col("pos") % 13 == 0,
        }
    )
    return search.sort_list(df, "fileName").select("pos", "name", "partition")


@register(f"SELECT type, count(*) AS n FROM {_INV} WHERE CAST(left(date, 4) AS INT) < 1996 AND parse_ok = 1 GROUP BY 1")
def previous_year(spark, sf_dir):
    status = F.when(F.col("parse_ok") == 1, "parsed").otherwise("error")
    df = invoices(spark, sf_dir).where(dates.is_previous_year(status, F.col("date"), 1996))
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT id, date FROM {_INV} WHERE date >= '1998-01-01'")
def retention(spark, sf_dir):
    return store.retained(invoices(spark, sf_dir), "1998-01-01", "date").select("id", "date")


def _exported(spark, sf_dir, orders):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("*"), "p_brand", F.lit("*"), "p_name").alias("xmmc"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = lines.groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                "xmmc", F.lit("").alias("ggxh"), F.lit("").alias("dw"), F.col("l_quantity").alias("sl"), F.lit(0.0).alias("dj"),
                F.col("l_extendedprice").alias("je"), F.col("l_linenumber").alias("slv"), F.col("l_tax").alias("se"),
            )
        ).alias("line_items")
    )
    rows = export.flatten(orders.select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("recordId"), F.col("taxRate").alias("line"), "xmmc",
        F.when(F.col("xmmc").isNotNull(), F.col("classificationCode")).alias("classificationCode"), "quantity", "lineAmount",
    )


@register(
    """SELECT CAST(o_orderkey AS VARCHAR) AS "recordId", l_linenumber AS line, '*' || p_brand || '*' || p_name AS xmmc, p_brand AS "classificationCode",
       l_quantity AS quantity, l_extendedprice AS "lineAmount" FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey) ON l_orderkey = o_orderkey"""
)
def export_rows(spark, sf_dir):
    return _exported(spark, sf_dir, table(spark, sf_dir, "orders"))


@register(
    """SELECT CAST(o_orderkey AS VARCHAR) AS "recordId", l_linenumber AS line, '*' || p_brand || '*' || p_name AS xmmc, p_brand AS "classificationCode",
       l_quantity AS quantity, l_extendedprice AS "lineAmount" FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey) ON l_orderkey = o_orderkey"""
)
def export_all_rows(spark, sf_dir):
    return _exported(spark, sf_dir, table(spark, sf_dir, "orders"))


@register(
    """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders), l AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS e FROM lineitem)
       SELECT count(DISTINCT l_orderkey) AS n_invoices, CAST((SELECT sum(t) FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM l)) AS DOUBLE) AS total,
       CAST(sum(e) AS DOUBLE) AS lines FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o)"""
)
def export_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = stats.export_totals(rows, {"total": "o_totalprice"}, {"lines": "l_extendedprice"}, "l_orderkey", "l_linenumber")
    return out.withColumns({"total": F.col("total").cast("double"), "lines": F.col("lines").cast("double")})


@register("SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_orderkey) AS INT) AS serial FROM lineitem")
def serial_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("pos"))
    return stats.serial_numbers(rows, "l_orderkey", "pos").select("l_orderkey", "l_linenumber", "serial")


@register(
    """WITH d AS (SELECT l_orderkey, arg_min(l_extendedprice, {'p': l_linenumber * 1000000 + l_partkey, 'a': l_extendedprice}) AS a, max(l_returnflag = 'R') AS f, max(l_shipdate < DATE '1995-01-01') AS p FROM lineitem GROUP BY 1)
       SELECT count(*) AS documents, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(f AS INT)) AS BIGINT) AS failed,
       CAST(sum(CAST(p AS INT)) AS BIGINT) AS previous_year FROM d"""
)
def doc_view(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("instance"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page_num"), F.col("l_extendedprice").alias("amount"),
        (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("previous_year"),
    )
    return stats.document_view(rows).withColumn("amount", F.col("amount").cast("double"))


@register(
    """WITH s AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS st FROM conversations
       WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS group_id FROM s"""
)
def page_groups(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return pages.group_pages(df, "conv_id", "turn", "role")


@register(
    """SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, string_agg(text, '|' ORDER BY turn) AS texts, count(*) AS n_pages
       FROM conversations GROUP BY 1"""
)
def page_merge(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("first_role"), F.col("role").alias("last_role"), F.array("text").alias("texts")
    )
    out = pages.merge_pages(df, ["conv_id"], "turn", ["first_role"], ["last_role"], ["texts"])
    return out.withColumn("texts", F.array_join("texts", "|"))


@register(
    """WITH g AS (SELECT user_id, epoch(ts) AS t, event_id FROM events), j AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS jump FROM g
       WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, event_id, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS cluster FROM j"""
)
def gap_clusters(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return layout.gap_clusters(df, ["user_id"], "t", 86400.0).drop("t")


@register("SELECT p_partkey, CAST((p_retailprice >= 950) AS INT) + CAST((p_retailprice >= 1000) AS INT) + CAST((p_retailprice >= 1050) AS INT) AS bucket FROM part")
def bucket_range(spark, sf_dir):
    bounds = F.array(F.lit(950.0), F.lit(1000.0), F.lit(1050.0))
    return table(spark, sf_dir, "part").select("p_partkey", layout.bucket_of(F.col("p_retailprice"), bounds).alias("bucket"))


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_new(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(seen, "p_partkey", "left_anti")


@register(
    """SELECT l_orderkey, l_linenumber, abs(l_extendedprice - round(l_quantity * (l_extendedprice / l_quantity), 2)) > greatest(0.05, abs(l_extendedprice) * 0.001) AS bad_price,
       (SELECT min(abs(l_tax - r)) FROM (VALUES (0.0), (0.01), (0.03), (0.05), (0.06), (0.09), (0.13), (0.17)) v(r)) > 0.005 AS bad_rate FROM lineitem"""
)
def line_checks(spark, sf_dir):
    q, e, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    found = money.line_check(q, e / q, e, t, F.round(e * t, 2))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_contains(found, "price").alias("bad_price"), F.array_contains(found, "rate").alias("bad_rate")
    )


@register(
    """SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 'none' WHEN abs(o_totalprice - (n + x)) > 0.1 THEN 'warn' WHEN abs(o_totalprice - (n + x)) > 0.01 THEN 'note' ELSE 'ok' END AS state
       FROM (SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice / 2) AS DOUBLE) AS n, CAST(ceil(o_totalprice / 2) AS DOUBLE) AS x FROM orders)"""
)
def header_equation(spark, sf_dir):
    p = F.col("o_totalprice")
    half, rest = F.floor(p / 2).cast("double"), F.ceil(p / 2).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", money.header_check(p, half, rest).alias("state"))


@register(
    """SELECT l_orderkey, abs(t - s) > 1.0 AS differs FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1)
       JOIN (SELECT o_orderkey, o_totalprice AS t FROM orders) ON o_orderkey = l_orderkey"""
)
def line_sum_check(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(stats.exact(F.col("l_extendedprice"))).cast("double").alias("s"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sums.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", (F.abs(F.col("o_totalprice") - F.col("s")) > 1.0).alias("differs"))


@register(
    """WITH c AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, CAST(l_partkey AS VARCHAR) AS value, l_quantity AS score, l_discount AS confidence, l_linenumber FROM lineitem),
       b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, score DESC, l_linenumber DESC, value DESC) AS k FROM c),
       w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY score DESC, field DESC) AS j FROM b WHERE k = 1)
       SELECT doc_id, field, value, score, confidence FROM w WHERE j = 1"""
)
def resolve_fields(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"),
        F.col("l_quantity").alias("score"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("source_rank"), F.lit(0.0).alias("distance"),
    )
    return extract.resolve(c)


@register(
    """SELECT doc_id, CASE WHEN coalesce(lang, '') = '' OR n_chars / 1000.0 < 0.6 THEN 'exception' WHEN n_chars / 1000.0 < 0.85 THEN 'review' ELSE 'accept' END AS queue FROM documents"""
)
def issues(spark, sf_dir):
    found = extract.field_issues({"lang": (F.col("lang"), F.col("n_chars") / 1000), "source": (F.lit("x"), F.lit(1.0))})
    return table(spark, sf_dir, "documents").select("doc_id", extract.route(found).alias("queue"))


@register(
    """WITH h AS (SELECT doc_id AS pos, sha256(text) AS hash, 'n' || (doc_id % 5) || '.pdf' AS name_key FROM documents),
       r AS (SELECT hash, name_key, min(pos) AS pos, count(*) AS n_uploads FROM h GROUP BY 1, 2), q AS (SELECT hash, min(pos) AS root FROM r GROUP BY 1)
       SELECT r.pos, r.hash, r.name_key, r.n_uploads, CAST(r.pos <> q.root AS INT) AS is_duplicate, CASE WHEN r.pos <> q.root THEN q.root END AS duplicate_of FROM r JOIN q ON r.hash = q.hash"""
)
def hash_dedup(spark, sf_dir):
    d = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(
        d.alias("pos"), F.sha2("text", 256).alias("hash"), F.concat(F.lit("N "), (d % 5).cast("string"), F.lit(".PDF")).alias("file_name")
    )
    return store.content_duplicates(files)


_LOG = """(SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (ORDER BY ts, event_id) AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CASE event_id % 4 WHEN 0 THEN 'upsert' WHEN 1 THEN 'update' WHEN 2 THEN 'soft_delete' ELSE 'restore' END AS op FROM events)"""


def _log(spark, sf_dir):
    ops = F.element_at(F.array(*[F.lit(x) for x in ("upsert", "update", "soft_delete", "restore")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.struct("ts", "event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        ops.alias("op"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("data"),
    )


@register(
    f"""SELECT id, (arg_max({{'at': CASE WHEN op = 'soft_delete' THEN ts END}}, pos) FILTER (WHERE op <> 'update')).at AS deleted_at, count(*) AS n_ops FROM {_LOG} GROUP BY 1"""
)
def oplog_last_state(spark, sf_dir):
    return store.last_state(_log(spark, sf_dir))


@register(
    """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) * 1000 + event_id % 1000 AS pos, event_id % 4 AS op, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(value AS VARCHAR) AS v FROM events),
       b AS (SELECT id, min(pos) AS p0 FROM l WHERE op = 0 GROUP BY 1)
       SELECT id, '{"value":"' || (arg_max(v, pos) FILTER (WHERE op < 2)) || '"}' AS data, (arg_max({'at': CASE WHEN op = 2 THEN ts END}, pos) FILTER (WHERE op <> 1)).at AS deleted_at,
       false AS hard_deleted, count(*) AS n_ops FROM l JOIN b USING (id) WHERE pos >= p0 GROUP BY 1"""
)
def oplog_fold(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("pos", F.unix_micros(F.col("pos.ts").cast("timestamp")) * 1000 + F.col("pos.event_id") % 1000)
    return store.fold_oplog(log).select("id", F.to_json("data").alias("data"), "deleted_at", "hard_deleted", "n_ops")


@register(
    f"""WITH f AS (SELECT pos, name, replace(name, '_p2', '') AS asked FROM {_FILES}),
        e AS (SELECT name, max(pos) AS id FROM f GROUP BY 1),
        p AS (SELECT regexp_replace(name, '_p[0-9]+\\.([^.]+)$', '.\\1') AS name, arg_min(pos, pos) AS id FROM f WHERE contains(name, '_p') GROUP BY 1)
        SELECT f.pos, '/in/' || f.asked AS name, coalesce(e.id, p.id) AS id FROM f LEFT JOIN e ON e.name = f.asked LEFT JOIN p ON p.name = f.asked
        WHERE coalesce(e.id, p.id) IS NOT NULL"""
)
def name_lookup(spark, sf_dir):
    files = _files(spark, sf_dir)
    asked = files.select("pos", F.concat(F.lit("/in/"), F.regexp_replace("name", "_p2", "")).alias("name"))
    return store.lookup_names(asked, files.select(F.col("pos").alias("id"), F.col("name").alias("file_name"), F.col("pos").alias("rec_pos")))


@register(
    """SELECT event_type AS batch_id, count(*) AS total, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS success,
       CAST(sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN user_id % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS done,
       CAST(floor(sum(CASE WHEN user_id % 3 < 2 THEN 1 ELSE 0 END) * 100.0 / count(*)) AS BIGINT) AS percent FROM events GROUP BY 1"""
)
def batch_progress(spark, sf_dir):
    u = F.col("user_id") % 3
    status = F.when(u == 0, "success").when(u == 1, "failed").otherwise("running")
    return stats.progress(table(spark, sf_dir, "events").select(F.col("event_type").alias("batch_id"), status.alias("status")))


@register("SELECT doc_id, left(sha256(text), 24) AS content_id, md5(source || '|' || lang) AS version FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashes.doc_id(F.col("text")).alias("content_id"), hashes.version_key(F.col("source"), F.col("lang")).alias("version")
    )


@register(
    """SELECT p_partkey, '''=' || p_name AS cell, left(replace(p_type, '/', '_'), 31) AS sheet, lower(replace(p_name, ' ', '')) AS name_key,
       'pdf' AS format FROM part"""
)
def text_cleaning(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.cell_text(F.concat(F.lit(" ="), n)).alias("cell"), text.sheet_name(F.col("p_type")).alias("sheet"),
        text.name_key(n).alias("name_key"), text.file_format(n).alias("format"),
    )


@register(
    """WITH o AS (SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '01', 'OI') AS n FROM orders),
       c AS (SELECT *, 'O-' || n AS m, array_to_string(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN n[i] = 'O' AND (regexp_matches(n[i - 1], '[0-9]') OR regexp_matches(n[i + 1], '[0-9]')) THEN '0' ELSE n[i] END), '') AS fixed FROM o)
       SELECT o_orderkey, CASE WHEN regexp_matches(n, '[0-9]') THEN CAST(o_orderkey AS VARCHAR) ELSE fixed END AS number, 'O-' || fixed AS mixed FROM c"""
)
def digit_fix(spark, sf_dir):
    """The twin looks at every character's neighbours, as its regular expressions know no look-around."""
    number = F.translate(F.col("o_orderkey").cast("string"), "01", "OI")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.digit_fix(number).alias("number"), text.digit_fix(F.concat(F.lit("O-"), number)).alias("mixed"))


_PLACES = " || ".join(
    f"translate(s[{i}], '0123456789', '零壹贰叁肆伍陆柒捌玖') || CASE WHEN s[{i}] <> '0' THEN '{unit}' ELSE '' END" + (" || '万'" if i == 4 else "")
    for i, unit in enumerate(("仟", "佰", "拾", "", "仟", "佰", "拾", ""), 1)
)


@register(
    f"""WITH c AS (SELECT o_orderkey, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
        w AS (SELECT *, lpad(CAST(c // 100 AS VARCHAR), 8, '0') AS s, translate(CAST(c // 10 % 10 AS VARCHAR), '123456789', '壹贰叁肆伍陆柒捌玖') AS j, translate(CAST(c % 10 AS VARCHAR), '123456789', '壹贰叁肆伍陆柒捌玖') AS f FROM c),
        t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PLACES}, '零+', '零', 'g'), '零万', '万'), '^万?零?', ''), '零$', '') AS t FROM w)
        SELECT o_orderkey, t || '元' || CASE WHEN c % 100 = 0 THEN '整' ELSE CASE WHEN j = '0' THEN '零' ELSE j || '角' END || CASE WHEN f = '0' THEN '整' ELSE f || '分' END END AS words,
        round(c % 100 / 100.0 + CAST(s[1] AS INT) * 1000 + CAST(s[2] AS INT) * 100 + CAST(s[3] AS INT) * 10 + CAST(s[4] AS INT) * 10000
          + CAST(s[5] AS INT) * 1000 + CAST(s[6] AS INT) * 100 + CAST(s[7] AS INT) * 10 + CAST(s[8] AS INT), 2)::DOUBLE AS back FROM t"""
)
def amount_words(spark, sf_dir):
    a = F.col("o_totalprice").cast("decimal(18,2)")
    words = money.amount_in_words("closed")(a)
    return table(spark, sf_dir, "orders").select("o_orderkey", words.alias("words")).withColumn("back", money.words_to_amount("words"))


@register(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INT) AS year,
       CASE WHEN o_orderdate > DATE '1998-07-01' + 30 OR year(o_orderdate) < 2000 THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence FROM orders"""
)
def date_fields(spark, sf_dir):
    raw = F.date_format("o_orderdate", "yyyy年M月d日")
    day = dates.date_text(raw)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("day"), dates.invoice_year(raw).alias("year"), dates.date_confidence(day, "1998-07-01").alias("confidence")
    )


@register("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS number, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def extract_fields(spark, sf_dir):
    body = F.concat(F.lit("电子发票 发票号码："), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(" 开票日期："), F.date_format("o_orderdate", "yyyy年MM月dd日"))
    flat = table(spark, sf_dir, "orders").select("o_orderkey", text.normalized_text(body).alias("flat"))
    return extract.with_fields(flat, "flat", number=extract.invoice_number, day=dates.first_date)


def _tokens(spark, sf_dir):
    """Lines of an order as tokens of a page: y from quantity, x from the line number."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_returnflag").alias("text"),
        (n * 20).alias("x0"), (q * 2).alias("y0"), (n * 20 + 15).alias("x1"), (q * 2 + 10).alias("y1"),
    )


@register(
    """WITH RECURSIVE t AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, l_quantity * 2 AS y0, l_quantity * 2 + 10 AS y1,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * 2 + 5, l_linenumber * 1000000 + l_partkey) AS k FROM lineitem),
       f AS (SELECT doc_id, k, pos, y0 AS a, y1 AS b, 0 AS "row" FROM t WHERE k = 1 UNION ALL
         SELECT t.doc_id, t.k, t.pos, CASE WHEN (least(y1, b) - greatest(y0, a)) / (y1 - y0) >= 0.4 THEN least(y0, a) ELSE y0 END,
           CASE WHEN (least(y1, b) - greatest(y0, a)) / (y1 - y0) >= 0.4 THEN greatest(y1, b) ELSE y1 END,
           "row" + CASE WHEN (least(y1, b) - greatest(y0, a)) / (y1 - y0) >= 0.4 THEN 0 ELSE 1 END
         FROM f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1)
       SELECT doc_id, pos, "row" FROM f"""
)
def row_bands(spark, sf_dir):
    return layout.rows_by_overlap(_tokens(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", "row")


@register(
    """WITH RECURSIVE t AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, l_quantity * 2 + 5 AS c,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * 2 + 5, l_linenumber * 1000000 + l_partkey) AS k FROM lineitem),
       f AS (SELECT doc_id, k, pos, c AS first, 0 AS "row" FROM t WHERE k = 1 UNION ALL
         SELECT t.doc_id, t.k, t.pos, CASE WHEN abs(c - first) <= 6 THEN first ELSE c END, "row" + CASE WHEN abs(c - first) <= 6 THEN 0 ELSE 1 END
         FROM f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1)
       SELECT doc_id, pos, "row" FROM f"""
)
def row_centers(spark, sf_dir):
    return layout.rows_by_first_center(_tokens(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", "row")


@register(
    """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, l_quantity * 2 + 5 AS c, l_returnflag AS f FROM lineitem), r AS (SELECT * FROM (VALUES (0, 'head', 0.0, 30.0), (1, 'items', 30.0, 80.0), (2, 'foot', 90.0, 120.0)) v(rank, region, top, bottom)),
       i AS (SELECT *, row_number() OVER () AS i FROM t),
       p AS (SELECT doc_id, pos, i, region, rank, CASE WHEN c BETWEEN top AND bottom THEN 0 ELSE least(abs(c - top), abs(c - bottom)) END AS e FROM i, r),
       k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY e, rank) AS n FROM p) SELECT doc_id, pos, region FROM k WHERE n = 1"""
)
def token_region(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("region"), F.lit(a).alias("top"), F.lit(b).alias("bottom")) for i, (n, a, b) in enumerate((("head", 0.0, 30.0), ("items", 30.0, 80.0), ("foot", 90.0, 120.0)))])
    regions = tokens.select("doc_id").distinct().select("doc_id", F.inline(rows))
    return layout.regions_of(tokens, regions).select("doc_id", "pos", "region")


@register(
    """SELECT l_orderkey AS doc_id, CAST(floor(l_quantity / 10) AS INT) AS "row", l_linenumber AS col, string_agg(l_returnflag, '' ORDER BY l_linenumber * 1000000 + l_partkey, l_returnflag) AS text
       FROM lineitem GROUP BY 1, 2, 3"""
)
def token_grid(spark, sf_dir):
    cells = _tokens(spark, sf_dir).withColumns({"row": F.floor(F.col("y0") / 20).cast("int"), "col": F.floor(F.col("x0") / 20).cast("int")})
    return layout.grid(cells, ["doc_id"])


@register(
    """SELECT o_orderkey, o_totalprice AS total, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice - 10, 2) ELSE floor(o_totalprice) END AS net,
       CASE WHEN o_orderkey % 3 = 0 THEN 10.0 WHEN o_orderkey % 3 = 1 THEN round(o_totalprice - floor(o_totalprice), 2) ELSE 1.0 END::DOUBLE AS tax FROM orders"""
)
def header_repair(spark, sf_dir):
    k, t = F.col("o_orderkey") % 3, F.col("o_totalprice")
    net = F.when(k != 0, F.floor(t).cast("double"))
    tax = F.when(k == 0, 10.0).when(k == 2, 1.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", repair.repaired_header(t, net, tax).alias("r")).select("o_orderkey", "r.total", "r.net", "r.tax")


@register("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((l_linenumber - 1) / 3) AS BIGINT) AS chunk, l_returnflag || '_' || l_linestatus AS name FROM lineitem")
def chunks_and_names(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", repair.chunk_of(F.col("l_linenumber") - 1, 3).alias("chunk"),
        repair.named([F.col("l_returnflag"), F.lit(""), F.col("l_linestatus")]).alias("name"),
    )


@register(
    """SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title>([^<]*)</', 1)), '') IS NOT NULL AS has_title, 'unknown' AS kind FROM pages"""
)
def html_fields(spark, sf_dir):
    title = xml_fields(F.col("html"), {"title": ("nothere", "title")})[0]
    return table(spark, sf_dir, "pages").select("page_id", title, detected_type(F.col("html").cast("binary"), F.lit("page.html")).alias("kind")).select(
        "page_id", F.col("title").isNotNull().alias("has_title"), "kind"
    )


@register(
    """WITH a AS (SELECT l_orderkey AS doc_id, l_extendedprice AS amount, l_linenumber * 20.0 AS x, l_quantity AS y FROM lineitem)
       SELECT l.doc_id, l.amount AS net, r.amount AS tax, CAST(r.x - l.x AS DOUBLE) AS gap FROM a l JOIN a r ON l.doc_id = r.doc_id AND abs(l.y - r.y) <= 8 AND l.x < r.x AND l.amount > r.amount"""
)
def amount_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("amount"), (F.col("l_linenumber") * 20.0).alias("x"), F.col("l_quantity").alias("y"))
    return matching.row_pairs(a).select("doc_id", "net", "tax", "gap")


@register()
def similar_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # Every customer meets one supplier.
    pair = c.join(s, F.col("c_custkey") % 10 == F.col("s_suppkey"))
    return pair.select("c_custkey", matching.name_similarity(F.col("c_name"), F.col("s_name")).alias("similarity"))
