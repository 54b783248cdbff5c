"""Members of a bucket meet the class with most occurrences: one pair per near copy, whatever bands they share."""

import random

from ledgerweave.llm import near_dedup


def test_copies_meet_their_original_once(spark, monkeypatch):
    rng = random.Random(41)
    words = [f"v{i}" for i in range(60)]
    texts = {100: " ".join(words)}
    for i in range(30):
        texts[i] = " ".join([*words[:30], f"x{i}", *words[31:]])
    bands = [(j, {100, *rng.sample(range(30), 15)}) for j in range(8)]
    rows = [(rep, 56, 500 if rep == 100 else 1, j) for j, reps in bands for rep in reps]
    entries = spark.createDataFrame(rows, "rep long, n int, w long, band long")
    formed, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: formed.append(pairs.count()) or verified(pairs, *rest))
    members = {r[0] for r in rows}
    got = near_dedup.linked(entries, spark.createDataFrame([(i, texts[i]) for i in members], "doc_id long, text string"), 5, 80).collect()
    assert {r.node for r in got} == members and len({r.component for r in got}) == 1
    assert sum(formed) == len(members) - 1
