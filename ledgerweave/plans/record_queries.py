"""Queries over jobs, records, pages and table cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.operators import jobs, records
from ledgerweave.plans.catalog import register
from ledgerweave.sources.tables import table


@register(
    """SELECT id, job FROM (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'del' ELSE 'put' END, {'t': ts, 'e': event_id}) AS op,
       arg_max(event_type, {'t': ts, 'e': event_id}) AS job FROM events GROUP BY 1) WHERE op = 'put'"""
)
def job_store(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.struct("ts", "event_id").alias("pos"),
        F.when(F.col("event_id") % 5 == 0, "del").otherwise("put").alias("op"), F.col("event_type").alias("job"),
    )
    return jobs.job_store(log)


_STATUS = "CASE event_id % 7 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' ELSE 'running' END"


@register(
    f"""SELECT user_id AS task, CASE WHEN max(CAST(s = 'cancelled' AS INT)) = 1 THEN 'cancelled' WHEN max(CAST(s = 'failed' AS INT)) = 1 THEN 'failed'
        WHEN max(CAST(s = 'completed' AS INT)) = 1 THEN 'completed' ELSE 'running' END AS status FROM (SELECT user_id, {_STATUS} AS s FROM events) GROUP BY 1"""
)
def task_states(spark, sf_dir):
    k = F.col("event_id") % 7
    status = F.when(k == 0, "cancelled").when(k == 1, "failed").when(k == 2, "completed").otherwise("running")
    return jobs.task_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), status.alias("status")))


@register(
    """SELECT l_orderkey AS batch_id, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 40) > 0 THEN 'running'
       WHEN count(*) FILTER (WHERE l_returnflag <> 'R') = 0 THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY 1"""
)
def batch_states(spark, sf_dir):
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "running").when(F.col("l_returnflag") == "R", "failed").otherwise("success")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), status.alias("status"), "l_returnflag")
    return jobs.batch_state(li)


@register(
    """SELECT event_id, (event_type = 'click' AND h > 2.0) OR (event_type = 'purchase' AND h > 0.5) AS batch_gone, event_type IN ('click', 'purchase') AND h > 24.0 AS job_gone
       FROM (SELECT event_id, event_type, (event_id % 60) / 2.0::DOUBLE AS h FROM events)"""
)
def expired_jobs(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "failed").when(kind == "purchase", "completed").otherwise("running")
    job = F.when(kind == "click", "failed").when(kind == "purchase", "success").otherwise("running")
    h = (F.col("event_id") % 60) / 2.0
    return table(spark, sf_dir, "events").select("event_id", jobs.batch_expired(status, h).alias("batch_gone"), jobs.job_expired(job, h).alias("job_gone"))


@register(
    """SELECT o_custkey AS batch_id, o_orderkey AS job_id, l_extendedprice AS amount, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"""
)
def batch_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("line"))
    return jobs.batch_results(o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("job_id")), state, li).drop("status")


@register(
    """SELECT event_type AS parser, count(*) AS total_calls, count(*) FILTER (WHERE user_id % 3 = 0) AS success_calls, CAST(sum(event_id % 100) AS DOUBLE) / count(*) AS avg_elapsed_ms,
       CAST(count(*) FILTER (WHERE user_id % 3 = 0) AS DOUBLE) / count(*) AS success_rate FROM events GROUP BY 1"""
)
def parser_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("parser"), (F.col("user_id") % 3 == 0).alias("ok"), (F.col("event_id") % 100).alias("elapsed_ms"))
    return jobs.parser_stats(e)


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 THEN least(100, CAST(round_even(l_linenumber / l_quantity * 100, 0) AS INT)) ELSE 0 END AS percent,
       CAST(ceil(l_quantity / 4) AS BIGINT) AS sheets FROM lineitem"""
)
def progress_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", jobs.percent_done(F.col("l_linenumber"), F.col("l_quantity")).alias("percent"),
        jobs.printable_sheets(F.col("l_quantity"), 4).cast("long").alias("sheets"),
    )


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return jobs.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@register(
    """WITH RECURSIVE u AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
         CASE event_id % 6 WHEN 0 THEN 'splitting' WHEN 1 THEN 'ready' WHEN 2 THEN 'parsing' WHEN 3 THEN 'parsed' WHEN 4 THEN 'error' ELSE 'cancelled' END AS s FROM events),
       f AS (SELECT DISTINCT file, 0::BIGINT AS k, 'uploading' AS now FROM u UNION ALL
         SELECT f.file, u.k, CASE WHEN (now = 'uploading' AND s IN ('splitting', 'ready', 'parsing')) OR (now = 'splitting' AND s IN ('ready', 'parsing', 'error', 'cancelled'))
           OR (now = 'ready' AND s IN ('parsing', 'error')) OR (now = 'parsing' AND s IN ('parsed', 'error', 'cancelled')) OR (now = 'error' AND s = 'parsing') OR now = 'cancelled'
           THEN s ELSE now END FROM f JOIN u ON u.file = f.file AND u.k = f.k + 1)
       SELECT file, arg_max(now, k) AS status FROM f GROUP BY 1"""
)
def file_states(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("splitting", "ready", "parsing", "parsed", "error", "cancelled")])
    status = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    return jobs.file_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("pos"), status.alias("status")))


@register("SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 5")
def latest_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return jobs.latest_jobs(o, 20, 5)


@register(
    """SELECT c_custkey, c_mktsegment AS memo, 'kept' AS id_field, CAST(c_acctbal AS VARCHAR) AS amount FROM customer WHERE c_nationkey <> 3
       UNION ALL SELECT c_custkey, 'old', 'kept', '0' FROM customer WHERE c_nationkey = 3"""
)
def field_updates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    data = F.create_map(F.lit("memo"), F.lit("old"), F.lit("hash"), F.lit("kept"), F.lit("amount"), F.lit("0"))
    rows = c.select(F.col("c_custkey").alias("id"), data.alias("data"), F.when(F.col("c_nationkey") == 3, "2024").alias("deleted_at"))
    fields = F.create_map(F.lit("memo"), F.col("c_mktsegment"), F.lit("hash"), F.lit("changed"), F.lit("amount"), F.col("c_acctbal").cast("string"))
    out = records.updated(rows, c.select(F.col("c_custkey").alias("id"), fields.alias("fields")))
    return out.select(F.col("id").alias("c_custkey"), F.col("data.memo").alias("memo"), F.col("data.hash").alias("id_field"), F.col("data.amount").alias("amount"))


@register(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS file_name, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date,
       strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'"""
)
def duplicates_of_number(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("file_name"), F.col("o_totalprice").alias("amount"), day.alias("date"),
        day.alias("created_at"), F.col("o_orderpriority").alias("number"), F.when(F.col("o_orderstatus") == "P", "x").alias("deleted_at"),
    )
    return records.duplicates_of(rows, "1-URGENT")


@register(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS "invoiceType", lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS "invoiceNumber",
       CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END::DOUBLE AS "totalAmount",
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(o_orderkey % 100 AS DECIMAL(18,2)) AS DOUBLE) AS net FROM orders"""
)
def export_shapes(spark, sf_dir):
    """Aliased keys: an empty first one leaves the second, an amount that is no number becomes 0."""
    status, total = F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    fields = F.create_map(
        F.lit("type"), F.when(status == "F", F.col("o_orderpriority")).otherwise(""), F.lit("invoiceType"), status,
        F.lit("invoiceNumber"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("amountHj"), F.when(status == "O", "none").otherwise(total),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *records.exported(fields), records.net_amount(total, (F.col("o_orderkey") % 100).cast("string")).alias("net"))
    return rows.select("o_orderkey", "invoiceType", "invoiceNumber", "totalAmount", "net")


@register(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'parser' WHEN o_orderkey % 4 = 1 THEN 'parser' ELSE o_orderpriority END AS kind,
       (CAST(o_orderkey % 3 > 0 AS INT) + CAST(length(CAST(o_orderkey AS VARCHAR)) = 3 AS INT) + CAST(o_totalprice > 100000 AS INT)) >= 2 AS structured FROM orders"""
)
def structured_records(spark, sf_dir):
    k = F.col("o_orderkey")
    found = F.when(k % 4 == 0, "其他").when(k % 4 == 1, "").otherwise(F.col("o_orderpriority"))
    number = F.concat(F.lit("FP-"), F.lpad(k.cast("string"), 5, "0"), F.when(F.length(k.cast("string")) == 3, "123").otherwise("1234"))
    amount = F.when(F.col("o_totalprice") > 100000, F.format_number("o_totalprice", 2)).otherwise("0.00")
    kind = F.when(k % 3 == 0, "其他").otherwise("专票")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", records.overridden(found, F.lit("parser"), "type").alias("kind"), records.is_structured(kind, number, amount).alias("structured")
    )


@register(
    """SELECT conv_id, arg_min(role, turn) AS name, count(*) AS n_pages, min(turn) AS first_pos, max(CASE WHEN turn > 1 THEN conv_id || ':p' || turn END) AS last_page
       FROM conversations GROUP BY 1"""
)
def representative_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").alias("page_num"), F.col("role").alias("name"))
    ids = pages.groupBy("conv_id").agg(F.max(records.page_id(F.col("conv_id").cast("string"), F.col("page_num"))).alias("last_page"))
    return records.representatives(pages, ["conv_id"]).join(ids, "conv_id")


@register(
    """WITH t AS (SELECT p_type AS type, min(p_partkey) AS f, count(*) AS n, left(p_type, 1) AS s FROM part GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f, type) AS k FROM t) SELECT type, n, CASE WHEN k = 1 THEN s ELSE s || '(' || k || ')' END AS sheet FROM r"""
)
def sheets_by_type(spark, sf_dir):
    return records.sheets_by_type(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_partkey").alias("pos")), 1)


@register(
    """SELECT l_orderkey AS doc_id, coalesce(max(l_discount) FILTER (WHERE l_returnflag = 'A' AND l_linenumber <> 2), 0.0) AS "A",
       coalesce(max(l_discount) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <> 2), 0.0) AS "R" FROM lineitem GROUP BY 1"""
)
def best_confidences(spark, sf_dir):
    value = F.when(F.col("l_linenumber") == 2, "").otherwise("x")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), value.alias("value"), F.col("l_discount").alias("confidence"))
    return records.best_confidence(c, ["A", "R"])


@register(
    """SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total_amount,
       CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_tax, count(*) AS item_count FROM lineitem GROUP BY 1"""
)
def table_summaries(spark, sf_dir):
    amount = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return records.table_summary(table(spark, sf_dir, "lineitem").select("l_orderkey", amount.alias("amount"), F.col("l_quantity").cast("string").alias("tax")), "l_orderkey")


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'name' WHEN l_quantity BETWEEN 10 AND 25 THEN 'unit' WHEN l_quantity BETWEEN 30 AND 45 THEN 'amount' END AS col FROM lineitem"""
)
def column_centers(spark, sf_dir):
    at = records.column_at_center(F.col("l_quantity"), [("name", 1.0, 10.0), ("unit", 10.0, 25.0), ("amount", 30.0, 45.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("col"))


@register(
    """WITH d AS (SELECT l_orderkey, c, coalesce(avg(CASE WHEN l_linenumber % 5 = c THEN CAST(l_quantity > 25 AS INT) END), 0) AS s
         FROM lineitem, (VALUES (2), (3), (4)) v(c) GROUP BY 1, 2)
       SELECT l_orderkey, CAST(arg_max(c, s * 1000000 - c) AS INT) AS amount_col FROM d GROUP BY 1"""
)
def amount_columns(spark, sf_dir):
    text = F.when(F.col("l_quantity") > 25, "a 12").otherwise("abc")
    return records.amount_column(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 5).alias("col"), text.alias("text")), "l_orderkey", 5)


@register(
    """SELECT l_orderkey, l_returnflag, CAST(min(l_linenumber) AS DOUBLE) AS x0, min(l_quantity) AS y0, CAST(max(l_linenumber) AS DOUBLE) AS x1, max(l_quantity + l_linenumber) AS y1, count(*) AS n,
       median(CAST(l_linenumber AS DOUBLE)) AS median_height FROM lineitem GROUP BY 1, 2"""
)
def row_boxes(spark, sf_dir):
    n = F.col("l_linenumber").cast("double")
    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", n.alias("x0"), n.alias("x1"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + n).alias("y1"),
        F.col("l_partkey").alias("pos"), F.lit("t").alias("text"), F.lit(1.0).alias("score"),
    )
    out = records.row_boxes(t, ["l_orderkey", "l_returnflag"])
    return out.select("l_orderkey", "l_returnflag", "x0", "y0", "x1", "y1", F.length("text").cast("long").alias("n"), "median_height")


@register(
    """WITH c AS (SELECT l_orderkey, l_linenumber AS r, l_linenumber % 3 AS col, l_partkey, CASE WHEN l_quantity > 25 THEN 'x' ELSE ' ' END AS text FROM lineitem)
       SELECT * FROM c WHERE EXISTS (SELECT 1 FROM c d WHERE d.l_orderkey = c.l_orderkey AND d.col = c.col AND trim(d.text) <> '')"""
)
def filled_columns(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("r"), (F.col("l_linenumber") % 3).alias("col"), "l_partkey", F.when(F.col("l_quantity") > 25, "x").otherwise(" ").alias("text")
    )
    return records.without_empty_columns(c, ["l_orderkey"])


@register(
    """SELECT c_custkey AS pos, id AS record_id FROM customer JOIN (SELECT lower(o_clerk) AS k, max(o_orderkey) AS id FROM (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS o_clerk, o_orderkey FROM orders) GROUP BY 1) ON k = lower(c_name)"""
)
def reviews_by_name(spark, sf_dir):
    name = F.concat(F.lit(" Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))
    reviews = table(spark, sf_dir, "orders").select(name.alias("file_name"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("record_id"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.upper("c_name").alias("name"))
    return records.reviews_by_name(asked, reviews)
