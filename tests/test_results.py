"""Merged page results, records with defaults, client search and decision records."""

import json
import random

from ledgerweave.operators import decisions, pages, records, search

PAGES = "doc long, page int, number string, type string, date string, amount string, extra map<string,string>, line_items array<string>"


def test_merged_results(spark):
    rng = random.Random(6)
    names = ["fphm", "type", "kprq", "gmfmc", "amountHj", "bz", "kpr", "odd", "other"]
    rows, want = [], {}
    for doc in range(60):
        own = []
        for page in range(rng.randrange(1, 5)):
            extra = {k: rng.choice(["", "x", "y", f"p{page}"]) for k in rng.sample(names, rng.randrange(0, 6))} if rng.random() < 0.9 else None
            own.append((doc, page, f"n{page}", f"t{page}", f"d{page}", f"{page}.0", extra, rng.choice([None, [], [f"i{page}"], ["a", f"b{page}"]])))
        first, last = own[0][6] or {}, own[-1][6] or {}
        merged = {k: first.get(k) for r in own for k in (r[6] or {})}
        merged |= {k: last[k] for k in pages.LAST_PAGE_KEYS if k in last}
        top = list(own[0][2:5])
        if len(own) > 1:
            top = [merged.get(k) or t for k, t in zip(("fphm", "type", "kprq"), top)]
        want[doc] = (*top, own[-1][5], merged, [i for r in own for i in r[7] or []], len(own))
        rows += own
    rng.shuffle(rows)
    got = pages.merged_results(spark.createDataFrame(rows, PAGES), ["doc"]).collect()
    assert {r.doc: (r.number, r.type, r.date, r.amount, r.extra, r.line_items, r.page_count) for r in got} == want


def test_built_records(spark):
    schema = "hash_sha256 string, file_name string, file_format string, file_size long, type string, number string, amount string, date string, extra map<string,string>, line_items array<string>, parse_method string, raw_text string"
    rows = [("h", "a.pdf", "PDF", 5, "专票", "12345678", "¥1,200.50", "未知日期", {"gmfmc": "B", "amountSe": "-3"}, ["i"], "ocr", "x" * 6000), (None, "b", None, None, "其他", "未知号码", None, "2024-01-02", None, None, None, None)]
    one, two = records.built(spark.createDataFrame(rows, schema)).orderBy("file_name").collect()
    assert (one.amount, one.date, one.buyer, one.seller, one.tax_amount, one.parse_ok, len(one.raw_text), one.line_items) == (1200.5, "", "B", "", -3.0, 1, 5000, ["i"])
    assert (two.amount, two.date, two.note, two.tax_amount, two.parse_ok, two.raw_text, two.line_items) == (0.0, "2024-01-02", "", 0.0, 0, "", [])


def test_client_search(spark):
    df = spark.createDataFrame([(1, "acme|12", "X.pdf"), (2, "", "Acme.PDF"), (3, None, "b"), (4, "b", "ACME")], "i long, search_text string, name string")
    assert [sorted(r.i for r in search.client_found(df, q).collect()) for q in (" ACME ", "", None, "b", "x.pdf")] == [[1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [3, 4], []]


def test_decision_records(spark):
    rows = [
        ("c", "d1", "a", [("f1", 'q"\\', "FAIL"), ("f2", None, "PASS"), ("f3", "x", "FAIL")], None), ("c", "d2", None, [("f1", "x", "WARN")], None), ("c", "d3", "b", None, None), ("c", "d4", "b", [("f1", "x", "FAIL")], "miss"),
    ]
    df = spark.createDataFrame(rows, f"correlation_id string, document_id string, file_name string, fields {decisions.FIELDS}, reason string")
    found = {r.document_id: r for r in decisions.decided(df, "now").collect()}
    assert {d: (r.queue, r.status, r.field_count, r.id) for d, r in found.items()} == {
        "d1": ("review_queue", "pending", None, "d1_c"), "d2": ("export_ready", "export_ready", 1, "d2_c"), "d3": ("export_ready", "export_ready", 0, "d3_c"), "d4": ("exception_queue", "pending", None, "d4_c"),
    }
    assert json.loads(found["d1"].extracted_fields) == [{"field_id": f, "value": v, "status": s} for f, v, s in rows[0][3]] and json.loads(found["d1"].fail_reasons) == ["f1", "f3"]
    again = decisions.opened(decisions.decided(df, "now")).where("queue = 'review_queue'").first()
    assert [tuple(x) for x in again.fields] == rows[0][3] and again.failed == ["f1", "f3"]
    damaged = decisions.opened(spark.createDataFrame([("{", "x")], "extracted_fields string, fail_reasons string")).first()
    assert damaged.failed is None
