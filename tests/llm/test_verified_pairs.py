"""Pairs dealt out by their left side: batches of one left id, ids with several texts, small Arrow batches."""

import random

from helpers import shingles
from ledgerweave.llm import near_dedup


def test_pairs_in_batches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 3)
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(60)) for _ in range(4)]

    def near(text):
        words = text.split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = "x"
        return " ".join(words)

    rows = [(i, near(rng.choice(base))) for i in range(60)]
    rows += [(0, base[1]), (7, base[2]), (7, base[2])]  # ids with several texts
    pairs = sorted({(min(p), max(p)) for p in ((rng.choice([0, 1, 7, rng.randrange(60)]), rng.randrange(60)) for _ in range(500)) if p[0] != p[1]})
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(shingles(t, 4))
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y) and bool(x & y)
    want = [p for p in pairs if any(linked(x, y) for x in texts[p[0]] for y in texts[p[1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = near_dedup.verified(spark.createDataFrame(pairs, "a long, b long"), docs, 4, 80).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got)) == want and 10 < len(want) < len(pairs)
