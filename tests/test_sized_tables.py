"""Queries on tables with the keys, ties and gaps of larger copies, against their SQL."""

import duckdb
import pytest
from ledgerweave.functions import cleaning
from ledgerweave.operators import items
from ledgerweave.plans import catalog, invoice_queries, item_queries, text_queries  # noqa: F401  (registers its queries)
from pyspark.sql import functions as F

@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Orders 0 to 59 with up to 12 lines, several of one number; parts from 0 and from 1,180,000 on, as in 60 copies."""
    to = str(tmp_path_factory.mktemp("sized"))
    duckdb.sql(f"""COPY (SELECT i // 12 AS l_orderkey, i * 7919 % 20000 + i % 2 * 1180000 AS l_partkey, i * 31 % 1000 AS l_suppkey, CAST(i * 5 % 11 % 7 + 1 AS INT) AS l_linenumber,
        CAST(i * 13 % 50 + 1 AS DOUBLE) AS l_quantity, ['A', 'N', 'R'][i * 17 % 3 + 1] AS l_returnflag, 'O' AS l_linestatus FROM range(720) t(i) WHERE i % 12 <= i // 12 % 12) TO '{to}/lineitem.parquet' (FORMAT parquet)""")
    duckdb.sql(f"COPY (SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 1.5 AS o_totalprice FROM range(60) t(i)) TO '{to}/orders.parquet' (FORMAT parquet)")
    return to


def same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, tables)
    want = con.sql(catalog.ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_grid_of_large_part_keys(spark, tables):
    same_as_sql(spark, tables, "token_grid")


def test_derived_items_parses_each_text_once(spark, tables):
    same_as_sql(spark, tables, "derived_items")
    plan = catalog.QUERIES["derived_items"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 5


def test_item_tokens_search_labels_in_wide_tokens_only(spark, tables):
    same_as_sql(spark, tables, "item_tokens")
    text = "合计 12345678 123456789 12,345,678 1,234,567,890 2024-01-02 1.2345 l.5O 甲乙丙股份 壹佰 é9"
    found = spark.range(1).select(cleaning.item_tokens(F.lit(text)).alias("t")).first()["t"]
    assert found == ["12345678", "12,345,678", "2024", "-01", "-02", "1.23", "45", "1.50", "甲乙丙股份", "é9"]
    plan = catalog.QUERIES["item_tokens"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan


@pytest.mark.parametrize(("name", "sorts", "scans"), [("keyed_rows", 9, 2), ("carried_orphans", 2, 1), ("header_ranges", 9, 2)])
def test_item_areas_read_and_sort_little(spark, tables, name, sorts, scans):
    same_as_sql(spark, tables, name)
    plan = catalog.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") <= sorts and plan.count("FileScan parquet") <= scans


def test_orphans_over_small_batches(spark):
    rows = [(d, i, t) for d in range(3) for i, t in enumerate(["a", "1", "b", "#", "c", "d", "*x", "2", "n", "plain"])] + [(9, 0, "p"), (9, 1, "q"), (None, 0, "3"), (None, 1, "e")]
    text = F.col("text")
    lines = spark.createDataFrame(rows, "doc_id long, line int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = items.carried_orphans(lines, text.rlike("[0-9]"), text == "#", text.startswith("*"), text != "plain", 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(d, 1, "a 1 b c d") for d in range(3)} | {(d, 7, "*x 2 n") for d in range(3)} | {(9, 0, "p"), (9, 1, "q"), (None, 0, "3 e")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
