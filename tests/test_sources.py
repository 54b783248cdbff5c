import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions import repair
from ledgerweave.operators import matching
from ledgerweave.sources import records

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("number", T.StringType())])


def test_snapshots(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text(records.versioned_envelope([{"id": 5, "number": "1"}, {"id": "x", "number": "2"}]))
    assert [(r.id, r.number) for r in records.read_snapshot(spark, str(good), RECORD).orderBy("pos").collect()] == [("5", "1"), ("x", "2")]
    bare = tmp_path / "b.json"
    bare.write_text('[{"id": "y"}]')
    assert records.read_snapshot(spark, str(bare), RECORD).first().id == "y"
    new = tmp_path / "c.json"
    new.write_text('{"schemaVersion": 999, "invoices": []}')
    with pytest.raises(ValueError, match="999"):
        records.read_snapshot(spark, str(new), RECORD)


def test_versions(spark, tmp_path):
    for v in (1, 2):
        records.write_snapshot(spark.range(v), str(tmp_path / "s"), v)
    (tmp_path / "s" / "version=000000000003").mkdir()
    assert records.latest_snapshot(spark, str(tmp_path / "s")).count() == 2


def test_queue(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "status": "open"}')
    (tmp_path / "b.json").write_text('{"id": "2", "status": "done"}')
    (tmp_path / "c.json").write_text("{broken")
    schema = "id string, status string"
    assert [r.id for r in records.read_queue(spark, str(tmp_path), schema).collect()] == ["2", "1"]
    assert [r.id for r in records.read_queue(spark, str(tmp_path), schema, "open").collect()] == ["1"]


def test_types_and_xml(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), "x"), (bytearray(b"zz"), "a.PNG"), (bytearray(b"zz"), "a.exe")], "c binary, n string")
    assert [r[0] for r in df.select(records.detected_type(F.col("c"), F.col("n"))).collect()] == ["pdf", "image", "unknown"]
    x = spark.createDataFrame([("<a><ns:Fphm> 1&amp;2 </ns:Fphm></a>",), ("<a><",)], "x string")
    assert [r[0] for r in x.select(*records.xml_fields(F.col("x"), {"number": ("no", "fphm")})).collect()] == ["1&2", None]


def test_matching(spark):
    found = spark.createDataFrame([("d", "Total: 12"), ("d", "abcd"), ("d", "new"), ("e", "abcd")], "doc_id string, text string")
    known = spark.createDataFrame([("d", "total 12"), ("d", "xxabcdxx")], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in matching.new_lines(found, known).collect()) == [("d", "new"), ("e", "abcd")]
    one = spark.createDataFrame([("甲乙有限公司", "甲乙公司", "91310000A", "91310000B")], "a string, b string, t string, u string")
    near, tax = one.select(matching.name_similarity(F.col("a"), F.col("b")), matching.tax_id_similarity(F.col("t"), F.col("u"))).first()
    assert near == pytest.approx(0.5 + 0.5 * 4 / 6) and tax == pytest.approx(2 / 3)


def test_repair(spark):
    df = spark.createDataFrame([(113.0, 100.0, None), (None, 100.0, 13.0), (5.0, 5.0, None)], "t double, n double, x double")
    got = [tuple(r[0]) for r in df.select(repair.repaired_header(F.col("t"), F.col("n"), F.col("x"))).collect()]
    assert got == [(113.0, 100.0, 13.0), (113.0, 100.0, 13.0), (5.0, 5.0, 0.0)]
    q = spark.createDataFrame([([3.0, 7.0, 2.0], 14.0)], "a array<double>, n double").select(repair.best_quantity_price(F.col("a"), F.col("n"))).first()[0]
    assert (q.quantity, q.price) == (2.0, 7.0)
    names = spark.createDataFrame([(0, "a.pdf"), (1, "a.pdf"), (2, "b")], "i long, n string").select(repair.collision_name(F.col("n"), ["n"], "i").alias("o")).collect()
    assert sorted(r.o for r in names) == ["a.pdf", "a_1.pdf", "b"]


def test_config_of_a_missing_or_damaged_file_is_empty(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    (tmp_path / "list.json").write_text("[1]")
    assert [records.read_config(spark, str(tmp_path / f)) for f in ("good.json", "bad.json", "list.json", "none.json")] == [{"a": 1}, {}, {}, {}]
