"""Unique headers and states of files, step by step."""

import random
import re

from ledgerweave.functions import text
from ledgerweave.operators import items, jobs
from pyspark.sql import functions as F


def test_unique_headers(spark):
    rng = random.Random(3)
    cells = ["单 位", " 数量", "数  量", "品名", "项目名称", "", "  ", "A", "A ", "B c", "规 格 型号", "税\t率", "征收率"]
    rows = [[rng.choice(cells) for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    want = []
    for row in rows:
        out, seen = [], {}
        for cell in row:
            h = cell.strip()
            for word in text.SPACED_HEADERS:
                h = re.sub(r"\s*".join(word), word, h)
            h = items.HEADER_NAMES.get(h, h) or f"列{len(out)}"
            seen[h] = seen.get(h, -1) + 1
            out.append(h if not seen[h] else f"{h}_{seen[h]}")
        want.append(out)
    df = spark.createDataFrame(list(enumerate(rows)), "i long, h array<string>")
    assert [r.u for r in df.select("i", text.unique_headers(F.col("h"), items.HEADER_NAMES).alias("u")).orderBy("i").collect()] == want


def test_file_states(spark):
    rng = random.Random(4)
    names = ["splitting", "ready", "parsing", "parsed", "error", "cancelled", "odd", None]
    rows = [(rng.choice(["a", "b", "c", None, "d"]), pos, rng.choice(names)) for pos in range(400)]
    df = spark.createDataFrame(rows, "file string, pos int, status string").repartition(3)
    steps = spark.createDataFrame([(a, b) for a in [*names[:6], "uploading", "odd"] for b in names], "a string, b string")
    moves = {(r.a, r.b): r.m for r in steps.select("a", "b", jobs.moved(F.col("a"), F.col("b")).alias("m")).collect()}
    want = {}
    for file, _, status in rows:
        now = want.get(file, "uploading")
        want[file] = moves[now, status]
    assert {r.file: r.status for r in jobs.file_states(df).collect()} == want
    assert jobs.file_states(df.limit(0)).count() == 0
