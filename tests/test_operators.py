import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import repair
from ledgerweave.operators import export, extract, layout, matching, pages, search, stats, store
from ledgerweave.streaming import oplog


def test_content_duplicates(spark):
    rows = [(0, "h", "A.pdf"), (1, "h", "B.pdf"), (2, "h", "a .PDF"), (3, None, "C"), (4, None, "C")]
    got = {r.pos: (r.name_key, r.is_duplicate, r.duplicate_of, r.n_uploads) for r in store.content_duplicates(spark.createDataFrame(rows, "pos long, hash string, file_name string")).collect()}
    assert got == {0: ("a.pdf", 0, None, 2), 1: ("b.pdf", 1, 0, 1), 3: ("c", 0, None, 1), 4: ("c", 0, None, 1)}


LOG = [
    ("upsert", "1", "t0", {"a": "1"}), ("update", "1", "t1", {"b": "2"}), ("soft_delete", "1", "t2", None), ("update", "9", "t3", {"x": "y"}),
    ("upsert", "2", "t4", {"a": "5"}), ("hard_delete", "2", "t5", None), ("restore", "2", "t6", None), ("restore", "1", "t7", None),
]


def test_fold(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(LOG)], "op string, id string, ts string, data map<string,string>, pos long")
    got = {r.id: (r.data, r.deleted_at, r.hard_deleted) for r in store.fold_oplog(df).collect()}
    assert got == {"1": ({"a": "1", "b": "2"}, None, False), "2": ({"a": "5"}, "t5", True)}


def test_stream_equals_fold(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    for part in (0, 1):
        lines = [json.dumps({"op": o, "id": i, "ts": t, "pos": p, "data": d}) for p, (o, i, t, d) in enumerate(LOG) if (p < 4) == (part == 0)]
        (src / f"{part}.json").write_text("\n".join([*lines, "{broken"]))
        os.utime(src / f"{part}.json", (1e9 + part * 100, 1e9 + part * 100))
    q = oplog.upsert_batches(oplog.fold_stream(oplog.read_log(spark, str(src), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.id: (json.loads(r.data), r.deleted_at, r.hard_deleted) for r in oplog.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"1": ({"a": "1", "b": "2"}, None, False), "2": ({"a": "5"}, "t5", True)}


def test_lookup(spark):
    rec = spark.createDataFrame([(1, "a_p1.pdf", 0), (2, "b.pdf", 1), (3, "b.pdf", 2)], "id long, file_name string, rec_pos long")
    ask = spark.createDataFrame([(0, "x/b.pdf"), (1, "a.pdf"), (2, "none"), (3, "B .pdf"), (4, "x/b.pdf")], "pos long, name string")
    assert [(r.pos, r.id) for r in store.lookup_names(ask, rec).orderBy("pos").collect()] == [(0, 3), (1, 1), (3, 3), (4, 3)]


def test_search(spark):
    rows = [(0, "A", "2024-01-01", "5", "x", None), (1, "A", "2024-01-02", "bad", "x", ""), (2, "A", None, "7", "y", None), (3, "B", "2024-01-01", "5", "x", "gone")]
    df = spark.createDataFrame(rows, "pos long, type string, date string, amount string, search_text string, deleted_at string").withColumn("created_at", F.lit("t"))
    page, total = search.search(df, search.SearchSpec(order_by="amount"))
    assert [r.pos for r in page.collect()] == [2, 0, 1] and total.first().total == 3
    page, _ = search.search(df, search.SearchSpec(order_by="nonsense", keyword="X"))
    assert [r.pos for r in page.collect()] == [0, 1]
    assert [r.pos for r in search.listed(df, 0, 1).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        search.SearchSpec(offset=-1)


def test_list_partitions(spark):
    rows = [("n1", False, None, False), ("py1", False, None, True), ("d1b", False, 1, False), ("d1a", False, 1, True), ("f1", True, 1, False), ("n2", False, None, False), ("py2", False, None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, name string, failed boolean, duplicate_group int, previous_year boolean")
    assert [r.name for r in search.sort_list(df, "").collect()] == ["f1", "d1a", "d1b", "py1", "py2", "n1", "n2"]


def test_totals_and_serials(spark):
    rows = [(0, "R1", 300.0, 100.0), (1, "R1", 300.0, 200.0), (2, "R2", 50.0, 50.0)]
    df = spark.createDataFrame(rows, "pos long, identity string, net double, line double")
    t = stats.export_totals(df, {"net": "net"}, {"line": "line"}).first()
    assert (t.n_invoices, float(t.net), float(t.line)) == (2, 350.0, 350.0)
    assert [r.serial for r in stats.serial_numbers(df).orderBy("pos").collect()] == [1, 1, 2]


def test_pages(spark):
    rows = [(1, i, v) for i, v in enumerate(["A", "A", None, "A", "B", None, None])]
    df = spark.createDataFrame(rows, "doc long, i long, v string")
    assert [r.group_id for r in pages.group_pages(df, "doc", "i", "v").orderBy("i").collect()] == [0, 0, 1, 2, 3, 4, 5]
    inst = store.number_of_copies(spark.createDataFrame([(0, "A", 1), (1, "A", 2), (2, "A", 1), (3, "A", 2)], "pos long, d string, p long"), ["d", "p"])
    assert [r.instance for r in inst.orderBy("pos").collect()] == [1, 1, 2, 2]
    m = spark.createDataFrame([("共3页 第2页",)], "x string").select(*pages.page_marker(F.col("x"))).first()
    assert tuple(m) == (2, 3)
    for x, want in (("第2页/3", (2, 3)), ("第 1 页 共 4 页", (1, 4)), ("2024/1/3", (None, None)), (None, (None, None))):
        m = spark.createDataFrame([(x,)], "x string").select(*pages.page_marker(F.col("x"))).first()
        assert tuple(m) == want


def test_layout(spark):
    rows = [("d", i, 0.0, y, 1.0, y + 10) for i, y in enumerate([0.0, 4.0, 8.0, 30.0])]
    t = spark.createDataFrame(rows, "doc_id string, pos long, x0 double, y0 double, x1 double, y1 double")
    assert [r.row for r in layout.rows_by_first_center(t, ["doc_id"]).orderBy("pos").collect()] == [0, 0, 1, 2]
    assert [r.row for r in layout.rows_by_overlap(t, ["doc_id"]).orderBy("pos").collect()] == [0, 0, 0, 1]
    boxes = spark.createDataFrame([("d", 0, 0.0, 0.0, 1.0, 10.0), ("d", 1, 0.0, 2.0, 1.0, 30.0), ("d", 2, 0.0, 16.0, 1.0, 16.0)], t.schema)
    assert [r.row for r in layout.rows_by_overlap(boxes, ["doc_id"]).orderBy("pos").collect()] == [0, 1, 1]
    twice = spark.createDataFrame([("d", 0, 0.0, 0.0, 10.0, 4.0)] * 2, t.schema)
    regions = spark.createDataFrame([("d", 0, "head", 5.0, 9.0), ("d", 1, "body", 1.0, 3.0)], "doc_id string, rank int, region string, top double, bottom double")
    assert [r.region for r in layout.regions_of(twice, regions).collect()] == ["body"] * 2
    columns = spark.createDataFrame([("d", 0, 0.0, 4.0), ("d", 1, 4.0, 20.0)], "doc_id string, col int, left double, right double")
    assert [r.col for r in layout.columns_by_overlap(twice, columns).collect()] == [1, 1]
    items = spark.createDataFrame([("d", 0, "*a*x"), ("d", 1, "y"), ("d", 2, "*b*z")], "doc string, i long, t string")
    assert [r.t for r in layout.merge_continuations(items, "doc", "i", "t").orderBy("item").collect()] == ["*a*xy", "*b*z"]


def test_extract(spark):
    get = lambda s: spark.createDataFrame([(s,)], "x string").select(extract.invoice_number(F.col("x"))).first()[0]
    assert get("电话号码:12345678 发票号码：00012345") == "00012345"
    assert get("a\n12345678\nb") == "12345678" and get("nothing") == ""
    c = spark.createDataFrame([("d", "a", "v", 50.0, 0.5, 1, 0.0), ("d", "a", "w", 40.0, 0.9, 1, 0.0), ("d", "b", "w", 60.0, 0.4, 1, 0.0)], "doc_id string, field string, value string, score double, confidence double, source_rank int, distance double")
    assert [(r.field, r.value) for r in extract.resolve(c).collect()] == [("b", "w")]


def test_export(spark, tmp_path):
    assert export.chosen(["lineTax", "nope", "serialNo"]) == ["lineTax", "serialNo"] and export.visible(["lineTax", "serialNo"]) == ["serialNo", "lineTax"]
    with pytest.raises(ValueError):
        export.checked_path("/a/../b.csv", "csv")
    export.write_csv(spark.createDataFrame([("=x", 1.0)], "xmmc string, quantity double"), str(tmp_path / "o"), ["xmmc", "quantity"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()] == [("'=x", "1.0")]


def test_all_orders_are_exported(spark):
    from ledgerweave.plans.invoice_queries import export_all_rows

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert export_all_rows(spark, "/root/testdata/sf0.001").select("recordId").distinct().count() == orders


def test_long_digit_runs_sort_by_number(spark):
    from ledgerweave.functions.text import natural_key

    names = ["a" + "9" * 25, "a1" + "0" * 25, "a007", "a8", "b"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(natural_key(F.col("x"))).collect()] == ["a007", "a8", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_log_order_over_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"op":"upsert","id":"1","ts":"t","data":{"k":"old"}}\nbroken\n')
    (tmp_path / "b.json").write_text('{"op":"update","id":"1","ts":"t","data":{"k":"' + "new" * 400 + '"}}\n')
    got = store.fold_oplog(store.read_oplog(spark, str(tmp_path))).collect()
    assert [r.data["k"] for r in got] == ["new" * 400]


def test_job_and_record_operators(spark):
    from ledgerweave.operators import jobs, records

    moves = [("f", i, s) for i, s in enumerate(["parsed", "ready", "parsed", "parsing", "cancelled", "parsed"])] + [("g", 0, "unknown")]
    got = {r.file: r.status for r in jobs.file_states(spark.createDataFrame(moves, "file string, pos int, status string")).collect()}
    assert got == {"f": "parsed", "g": "uploading"}
    late = spark.createDataFrame([("t", "cancelled"), ("t", "completed"), ("u", "failed"), ("u", "completed"), ("v", None)], "task string, status string")
    assert {r.task: r.status for r in jobs.task_state(late).collect()} == {"t": "cancelled", "u": "failed", "v": "running"}
    row = spark.createDataFrame([("其他", "12345678", "¥1,000")], "k string, n string, a string")
    assert row.select(records.is_structured(F.col("k"), F.col("n"), F.col("a"))).first()[0]
    assert not row.select(records.is_structured(F.col("k"), F.lit(None).cast("string"), F.col("a"))).first()[0]
    assert row.select(records.overridden(F.lit("未知号码"), F.lit("1"), "number")).first()[0] == "1"
    rows = spark.createDataFrame([("1", {"memo": "a"}, None), ("2", {"memo": "a"}, "2024")], "id string, data map<string,string>, deleted_at string")
    new = spark.createDataFrame([(i, {"memo": "b", "hash_sha256": "x"}) for i in "12"], "id string, fields map<string,string>")
    assert {r.id: r.data for r in records.updated(rows, new).collect()} == {"1": {"memo": "b"}, "2": {"memo": "a"}}


def test_header_balance_by_rule(spark):
    """Free of tax, red, zero tax, adjusted, derived either way, nothing to go by."""
    rows = [
        (100.0, 100.0, None, 100.0, 0.0), (-106.0, -100.0, -6.0, -100.0, -6.0), (100.0, 100.02, 0.0, 100.02, 0.0), (100.0, 90.0, 5.0, 90.0, 10.0),
        (100.0, 90.0, None, 90.0, 10.0), (100.0, None, 6.0, 94.0, 6.0), (100.0, None, None, None, None), (None, 5.0, 1.0, 5.0, 1.0), (100.0, 120.0, None, 120.0, None),
        (1000.0, 940.0, 55.0, 940.0, 55.0),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "total double, net double, tax double")
    got = df.select(repair.balanced_header(F.col("total"), F.col("net"), F.col("tax")).alias("r")).select("r.net", "r.tax").collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def test_pair_without_anchor_is_the_tightest_then_the_lowest(spark):
    pairs = spark.createDataFrame([(1, 5.0, 1.0, 3.0, 10.0, 0.0), (1, 9.0, 2.0, 3.0, 40.0, 0.0), (1, 8.0, 2.0, 4.0, 90.0, 0.0)], "doc_id long, net double, tax double, gap double, y double, x double")
    none = spark.createDataFrame([], "doc_id long, ax double, ay double")
    assert [(r.net, r.tax) for r in matching.pair_at_anchor(pairs, none).collect()] == [(9.0, 2.0)]


def test_grouped_csv_begins_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "identity string, pos long, xmmc string")
    out = export.grouped(rows)
    assert [(r.serialNo, r.xmmc) for r in out.collect()] == [(1, "x"), (1, "z"), (2, "y")]
    export.write_csv(out, str(tmp_path / "g"), ["serialNo", "xmmc"])
    files = [p.read_bytes() for p in (tmp_path / "g").glob("part-*") if p.stat().st_size]
    assert files and all(f.startswith("\ufeffserialNo,xmmc".encode()) for f in files)
