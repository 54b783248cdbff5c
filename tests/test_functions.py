from decimal import Decimal

from pyspark.sql import functions as F

from ledgerweave.functions import dates, money, text
from ledgerweave.functions.hashes import doc_id


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_names(spark):
    assert one(spark, "A 2024年03\u3000月.PDF", text.name_key) == "a2024年03月.pdf"
    assert one(spark, None, text.name_key) == ""
    assert one(spark, "x_p12.pdf", text.without_page_suffix) == "x.pdf"
    assert one(spark, r"c:\a/b.pdf", text.base_name) == "b.pdf"
    assert one(spark, "a.TIF", text.file_format) == "image"
    assert one(spark, "=1+1", text.cell_text) == "'=1+1"
    assert one(spark, "甲 乙 x", text.company_name) == "甲乙 x"
    assert one(spark, " a\nb\n a ", text.distinct_lines) == "a\nb"


def test_natural_order(spark):
    df = spark.createDataFrame([("f10",), ("f9",), ("f1b",)], "x string").orderBy(text.natural_key(F.col("x")))
    assert [r.x for r in df.collect()] == ["f1b", "f9", "f10"]


def test_digits(spark):
    assert one(spark, "1O2l", text.digit_fix) == "1021"
    assert one(spark, "OK 1O", text.digit_fix) == "OK 10"
    assert one(spark, "1S.B", text.numeric_token) == "15.8"


def test_money(spark):
    assert one(spark, "¥1,234.5", money.safe_float) == 1234.5
    assert one(spark, "1-2", money.safe_float) == -12
    assert one(spark, "abc", money.safe_float) == 0
    assert one(spark, "*5", money.safe_float) == 5
    assert one(spark, "1,000", money.amount_text) == "1000.00"
    assert one(spark, "未知金额", money.amount_text) is None
    assert one(spark, 1.005, money.round_money, "double") == 1.01
    assert one(spark, -1.005, money.round_money, "double") == -1.01
    assert one(spark, "12.5元", money.leading_number) == 12.5
    assert one(spark, "13%", money.rate_of) == 0.13
    assert one(spark, "0.13", money.rate_of) == 0.13


def test_words(spark):
    cases = {0: "零元整", 5: "伍分", 1000: "壹拾元整", 10010: "壹佰元壹角", 1000500: "壹万零伍元整", 10000000000: "壹亿元整"}
    for cents, words in cases.items():
        assert money.words_of(cents) == words
    assert money.words_of(-100) == "负壹元整"
    got = one(spark, Decimal("100.10"), money.amount_in_words("closed"), "decimal(18,2)")
    assert got == "壹佰元壹角整"
    assert money.running_text_amount("壹佰元壹角") == 100.1
    # 万 counts the last digit only; commas and plain numerals count too.
    texts = {"壹拾贰万元": 20010.0, "三千五百元": 3500.0, "共 1,234.50 元": 1234.5, "零元整": None, "": None, "叁": 3.0, "（，）伍元": 5.0}
    assert {t: money.running_text_amount(t) for t in texts} == texts


def test_header_and_lines(spark):
    check = lambda *v: spark.createDataFrame([v], "t double, n double, x double").select(money.header_check(F.col("t"), F.col("n"), F.col("x"))).first()[0]
    assert [check(113.0, 100.0, 13.0), check(113.05, 100.0, 13.0), check(114.0, 100.0, 13.0), check(-1.0, 1.0, 0.0), check(0.0, 1.0, 1.0)] == ["ok", "note", "warn", "sign", "none"]
    row = spark.createDataFrame([(2.0, 5.0, 11.0, 0.2, 2.2)], "q double, p double, n double, r double, t double")
    assert row.select(money.line_check(*[F.col(c) for c in "qpnrt"])).first()[0] == ["price", "rate"]


def test_dates(spark):
    assert [one(spark, d, dates.date_text) for d in ("2024年1月2日", "2024/1/2", "x", None)] == ["2024-01-02", "2024-01-02", None, None]
    assert [one(spark, d, dates.invoice_year) for d in ("2024-01-01", "2024.1.1", "未知日期", "", None)] == [2024, 2024, None, None, None]
    assert one(spark, "开票日期：2024年02月30日", dates.first_date) == ""
    assert one(spark, "日期:2024-2-3", dates.first_date) == "2024-02-03"
    assert one(spark, "2024-13-01", dates.plausible_date) is False


def test_content_id_ignores_names(spark):
    assert len(one(spark, "abc", doc_id)) == 24
