"""Substring dedup and mixing where rows share ids, url templates with marks in segments."""

import random

import pytest
from helpers import documents
from ledgerweave.llm import mixing, substring_dedup, url_filter


def prose(rng, n):
    return " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randrange(99)) for _ in range(n))


def test_spans_are_cut_from_their_own_text(spark):
    """Two rows of one id: the one with another document's passage loses it, the other one keeps its words."""
    rng = random.Random(4)
    passage, own = prose(rng, 80), prose(rng, 300)
    rows = [(0, prose(rng, 30) + " " + passage, "s"), (1, passage + " " + prose(rng, 30), "s"), (1, own, "s"), (1, own, "s"), (None, own, "s"), (7, prose(rng, 100), "s")]
    docs = documents(spark, rows)
    got = substring_dedup.remove_passages(docs).collect()
    assert len(got) == 6 and sum(r.text == own for r in got) == 3
    cut = [r.text for r in got if r.doc_id == 1 and r.text != own]
    assert len(cut) == 1 and len(cut[0]) < len(rows[1][1]) - 0.8 * len(passage)
    found = substring_dedup.op4_query(docs).collect()
    assert {(r.doc_id, r.keeper, r.n_spans > 0) for r in found} == {(0, 0, False), (1, 0, True)}


def test_texts_of_one_id_are_documents(spark):
    rng = random.Random(6)
    passage = prose(rng, 90)
    docs = documents(spark, [(5, prose(rng, 20) + " " + passage, "s"), (5, passage + " " + prose(rng, 20), "s")])
    got = [r.text for r in substring_dedup.remove_passages(docs).collect()]
    assert sum(passage in t for t in got) == 1


def test_repeated_rows_meet_the_target(spark, tmp_path):
    """A source of repeats of one row, with or without an id, gives as many of them as fit."""
    rng = random.Random(3)
    same, other = prose(rng, 30), prose(rng, 20)
    rows = [(i, prose(rng, 50), "a") for i in range(60)] + [(i, prose(rng, 40), "b") for i in range(60, 100)]
    rows += [(None, same, "c")] * 100 + [(7, other, "d")] * 50 + [(7, prose(rng, 20), "d") for _ in range(50)]
    documents(spark, rows).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for keep in ((), ("n_chars",)):
        got = mixing.mix(docs, keep=keep).collect()
        assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
        for s in "abcd":
            target = next(r.target for r in got if r.source == s)
            assert sum(r.taken for r in got if r.source == s) == pytest.approx(target, abs=50), s
    assert sorted(map(tuple, mixing.op3_query(docs).collect()), key=str) == sorted(map(tuple, mixing.op3_query(docs).collect()), key=str)


def test_marks_in_segments_are_literal(spark):
    """A bad section under a segment that looks like a mark does not hide among the good ones."""
    for mark in ("*", "~", "~0", "$", "**", "\\*"):
        rows = [(f"/{mark}/{i}", 1) for i in range(40)] + [(f"/{i}/{i}", 0) for i in range(360)]
        pages = spark.createDataFrame([(i, f"http://h.org{p}") for i, (p, _) in enumerate(rows)], "page_id long, url string")
        labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")
        got = url_filter.filter_urls(pages, labels)
        assert {(r.page_id, r.verdict == "block") for r in got.collect()} == {(i, bool(b)) for i, (_, b) in enumerate(rows)}, mark


def test_verdicts_from_smoothed_purity(spark):
    """Shares and verdicts worked out again from the templates."""
    rng = random.Random(12)
    rows = [(f"http://{rng.choice(['a.org', 'b.net', 'example.com'])}/{rng.choice(['en', 'es', 'x', 'spam', 'shop'])}/{i % 37}", rng.random()) for i in range(700)]
    bad = {i: int("spam" in u and x < 0.9 or x < 0.1) for i, (u, x) in enumerate(rows) if i % 3}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = url_filter.filter_urls(pages, labels).collect()
    prior, sums = sum(bad.values()) / len(bad), {}
    for r in got:
        known = sums.setdefault((r.host, r.template), [])
        if r.page_id in bad:
            known.append(bad[r.page_id])
    for r in got:
        known = sums[r.host, r.template]
        share = (sum(known) + 8 * prior) / (len(known) + 8)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.bad_share == pytest.approx(share)
        assert (r.rule, r.verdict) == ((max(fits)[1], max(fits)[2]) if fits else (None, "block" if share >= 0.5 else "allow"))
    assert len({r.verdict for r in got}) == 2
