import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import checks, cleaning, dates, hashes
from ledgerweave.operators import documents, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_party_and_person_names(spark):
    got = lambda text: one(spark, cleaning.party_name(F.lit(text)))
    assert got(None) == "" and got("") == ""
    assert got("购买方信息 甲 公司 销售方信息乙") == "购买方信息甲公司"
    assert got("甲__AUX_x__乙 纳税人识别号 项目名称") == "甲乙"
    assert [one(spark, cleaning.person_name(F.lit(t))) for t in ("张 三", "小写", "开票人甲", "税务", None)] == ["张 三", "", "开票人甲", "", ""]


def test_ocr_rules_as_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("O0I1.,¥年月日-: 25") for _ in range(30)) for _ in range(200)] + ["", "票据号码：lO1o 纳税人识别号: oI9z"]

    def plain(text):
        turn = str.maketrans("OoIl", "0011")
        for label in ("发票号码", "票据号码"):
            text = re.sub(rf"({label}[:：])\s*([0-9OIol]+)", lambda m: m[1] + m[2].translate(turn), text)
        for p in (*cleaning.DATE_ZEROS, *cleaning.AMOUNT_ZEROS * 3):
            text = re.sub(p, "0", text)
        return re.sub(r"(纳税人识别号[:：])\s*([0-9A-Za-z]+)", lambda m: m[1] + m[2].upper().replace("O", "0"), text)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.x for r in df.select("i", cleaning.ocr_fixed(F.col("t")).alias("x")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_merged_rows_as_a_plain_loop(spark):
    rng = random.Random(5)
    pages = {p: [(i, rng.randrange(0, 200), rng.randrange(0, 40), rng.randrange(5, 30)) for i in range(n)] for p, n in ((0, 40), (1, 9), (2, 10), (3, 60))}
    rows = [(p, i, float(x), float(y), float(x + w), float(y + 8), f"t{i}", i / 10) for p, boxes in pages.items() for i, x, y, w in boxes]
    df = spark.createDataFrame(rows, "page long, pos long, x0 double, y0 double, x1 double, y1 double, text string, score double")
    got = sorted((r.page, r.x0, r.y0, r.x1, r.y1, r.text, round(r.score, 6), r.n_boxes) for r in documents.merged_rows(df, ["page"]).collect())
    want = []
    for p, boxes in pages.items():
        built = []
        for i, x, y, w in sorted(boxes, key=lambda b: (b[2], b[0])):
            for row in built if len(boxes) >= 10 else []:
                near = any(max(x - b[1] - b[3], b[1] - x - w) <= 15 for b in row)
                if abs(y - sum(b[2] for b in row) / len(row)) <= 4 and near:
                    row.append((i, x, y, w))
                    break
            else:
                built.append([(i, x, y, w)])
        for row in built:
            text = " ".join(f"t{b[0]}" for b in sorted(row, key=lambda b: (b[1], b[2], b[0])))
            want.append((p, min(b[1] for b in row), min(b[2] for b in row), max(b[1] + b[3] for b in row), max(b[2] + 8 for b in row), text, round(sum(b[0] for b in row) / 10 / len(row), 6), len(row)))
    assert got == sorted(want)


def test_elements_of_one_source_and_empty(spark):
    schema = "doc_id long, pos long, page int, text string, x0 double, y0 double, x1 double, y1 double"
    box = (0.0, 0.0, 10.0, 10.0)
    known, found, none = spark.createDataFrame([(1, 0, 1, "a", *box)], schema), spark.createDataFrame([(1, 1, 1, None, *box), (2, 0, 1, "b", *box), (2, 1, 1, "b", *box)], schema), spark.createDataFrame([], schema)
    rows = lambda a, b: sorted((r.doc_id, r.pos) for r in documents.merged_elements(a, b, ["doc_id"]).collect())
    assert rows(known, found) == [(1, 0), (2, 0)]
    assert rows(known, none) == [(1, 0)] and rows(none, none) == []


@pytest.mark.parametrize(
    "raw, want",
    [("12", f"{12:032x}"), ("f" * 32, "f" * 32), ("1" * 32, "1" * 32), ("9" * 31, f"{int('9' * 31):032x}"), ("18446744073709551615", f"{2**64 - 1:032x}"), ("-3", "-3"), ("x", "x"), (None, None)],
)
def test_hex_id(spark, raw, want):
    assert one(spark, hashes.hex_id(F.lit(raw).cast("string"))) == want


def test_times_and_dates(spark):
    assert one(spark, dates.beijing_seconds(F.lit("2024-01-01T00:00:00.5+03:00"))) == 1704038400.5
    assert one(spark, dates.beijing_seconds(F.lit("2024-01-01"))) == 1704038400.0
    assert one(spark, dates.beijing_seconds(F.lit("no"))) is None
    assert [one(spark, dates.date_in_format(F.lit(t), "MM/DD")) for t in ("2024-01-15", "2024-1-5", "未知日期", None)] == ["01/15", "2024-1-5", "", ""]


def test_safety_nets(spark):
    d = lambda x: F.lit(x).cast("decimal(18,4)")
    got = lambda *a, **k: one(spark, checks.amount_or_sum(*a, **k))
    assert got(F.lit("1,000"), d("5"), F.lit("1"), F.lit("1001")) == "1,000"
    assert got(F.lit("1,000"), d("5"), F.lit("1"), F.lit("1001"), strip_commas=False) == "5.00"
    assert got(F.lit(None).cast("string"), d("5.5"), F.lit(""), F.lit("")) == "5.50"
    assert got(F.lit("7"), F.lit(None).cast("decimal(18,4)"), F.lit(""), F.lit("")) == "7"


def test_numbers_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("pos"))
    assert all(r.n == r.pos + 1 for r in stats.numbered(df, "pos", "n").collect())
    assert stats.numbered(df.where("false"), "pos", "n").count() == 0
