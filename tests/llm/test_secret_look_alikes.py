"""Secret scans on keys and look-alikes of another generator, on the tables' own texts, and the candidates against another engine."""

import random
import string

import pytest
import regex
from helpers import documents
from ledgerweave.llm import secret_scan
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def planted(n=300):
    """Texts of invented words with one key or look-alike each."""
    rng = random.Random(21)
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexa, word = string.hexdigits[:16], lambda: draw("etaoinshrdlu", rng.randrange(2, 9))
    full = string.ascii_letters + string.digits
    keys = [
        lambda: f"token='{draw(hexa, 48)}'", lambda: f"my_api_key: {draw(full, 27)}{rng.randrange(10)}", lambda: f"ASIA{draw(string.ascii_uppercase + '234567', 16)}",
        lambda: f"password={draw(full, 13)}{rng.randrange(10)}x", lambda: f"gho_{draw(full, 36)}", lambda: f"Bearer eyJ{draw(full, 17)}.{draw(full, 40)}", lambda: f"sk-{draw(full, 32)}{rng.randrange(10)}",
        lambda: f"private_key = \"{draw(full, 44)}{rng.randrange(10)}\"", lambda: "-----BEGIN EC PRIVATE KEY-----", lambda: f"SECRET={draw(hexa, 32)}7",
    ]
    others = [
        lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(99)}.example.com", lambda: f"{draw('aeiou', 3)}{rng.randrange(99)}@srv{rng.randrange(9)}.some-company.org", lambda: draw(string.digits, 16),
        lambda: f"http://w{rng.randrange(99)}.test.net/{word()}/{rng.randrange(9999)}/{word()}", lambda: f"commit {draw(hexa, 40)}", lambda: f"checksum {draw(hexa, 64)}",
        lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: f"+{draw('123456789', 2)}-{draw(string.digits, 3)}-{draw(string.digits, 9)}", lambda: f"/home/{word()}/{word()}-{rng.randrange(99)}/{word()}.txt",
        lambda: f"DSC_{draw(string.digits, 8)}_{draw(string.digits, 4)}.jpg", lambda: f"{word()}-{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(30)}-linux-x64", lambda: f"invoice-{rng.randrange(2000, 2030)}-{draw(string.digits, 7)}",
        lambda: f"secret: {rng.choice(['weapon', 'garden', 'agents', 'ballot'])}", lambda: f"{draw(string.digits, 4)}.{draw(string.digits, 4)}.{draw(string.digits, 4)}.{draw(string.digits, 4)}",
    ]
    rows = []
    for i in range(2 * n):
        body = rng.choice(keys if i < n else others)()
        rows.append((i, " ".join(word() for _ in range(12)) + rng.choice([" ", "\n", ": "]) + body + rng.choice([" ", "\n", ", "]) + " ".join(word() for _ in range(12)), "s"))
    return rows, n


def test_precision_and_recall_on_another_generator(spark):
    rows, n = planted()
    found = secret_scan.scan(documents(spark, rows)).groupBy("doc_id").agg(F.max(F.col("is_secret").cast("int")).alias("s"))
    called = {r.doc_id for r in found.where("s = 1").collect()}
    right = sum(i < n for i in called)
    assert right / n >= 0.95 and right / len(called) >= 0.95


def test_tokens_of_the_tables_and_no_mail_hosts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = secret_scan.candidates(docs).withColumn("token", F.col("before").rlike('(?i)token = "$'))
    rows = secret_scan.scan(docs).join(near, ["doc_id", "nth", "start"]).select("token", "is_secret", "candidate").collect()
    assert sum(r.token for r in rows) >= 10 and any("example.com" in r.candidate for r in rows)
    assert all(r.token == r.is_secret for r in rows)


def test_candidates_as_another_engine_finds_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - i, t) for i, t, _ in planted(120)[0]]
    rows += [(-1000, None), (-1001, ""), (-1002, "é😀 token = \"abc1\" 😀 secret:xyz9 AKIA"), (-1003, "a1b2c3d4e5f6g7h8i9" * 3 + " token=" + "q" * 30)]
    want = []
    for i, text in rows:
        matches = list(regex.finditer(secret_scan.CANDIDATE, text or ""))
        ends = [0] + [m.end() for m in matches]
        starts = [m.start() for m in matches] + [len(text or "")]
        for k, m in enumerate(matches):
            before, after = text[ends[k] : m.start()], text[m.end() : starts[k + 1]]
            want.append((i, k, m.start(), m[0], before[-secret_scan.CONTEXT :], after[: secret_scan.CONTEXT]))
    got = secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 150


def test_many_candidates_in_one_text(spark):
    one = " ".join(f"abcdefgh{i:010d}" for i in range(20_000))
    found = secret_scan.candidates(spark.createDataFrame([(1, one)], "doc_id long, text string"))
    assert [r.start for r in found.orderBy("nth").select("start").collect()] == [19 * i for i in range(20_000)]


def test_limit_of_held_out_findings(spark):
    rows = [(1.0, 0.9), (1.0, 0.71), (0.0, 0.3), (0.0, 0.1)]
    assert secret_scan.best_limit(spark.createDataFrame(rows, "label double, p double")) == pytest.approx(0.52, abs=0.02)
    assert secret_scan.best_limit(spark.createDataFrame([], "label double, p double")) == 0.5
