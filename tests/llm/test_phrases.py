"""Phrase mining against brute force: odd characters, split prefixes, small batches, filters that let everything through."""

import random
import re
from collections import Counter

import pytest
from helpers import lower
from ledgerweave.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long, key long"


def brute(rows, least, longest, top, percent=100):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    some = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in some.items():
        longer = [b for (other, q), b in some.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    result = []
    for lang, found in out.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "of", "straße", "言葉", "a\x01", "a", "É", "é", "new-york", "x'y", "\x1f", "ß\x85z", " "]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "?!", ":"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    rows = [(text(rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    rows += [("the of a b c d e " * 30, "en"), ("new york city " * 9 + ".", "de"), (None, "en"), ("", None), ("\n\t .", "fr")]
    return rows + rows[:3]


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i % 7, t, g, "x", 1, 2) for i, (t, g) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in phrases.mine_phrases(docs.repartition(3), **options).collect())


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (10, 3, 7), (2, 2, 50)])
def test_equals_brute_force(spark, least, longest, top):
    rows = some_rows(least)
    got = mined(spark, rows, least=least, longest=longest, top=top)
    assert got == brute(rows, least, longest, top) and len(got) > 5


def test_split_prefixes_small_batches_and_full_filters(spark, monkeypatch):
    """Every word is a hot prefix, windows come a few at a time, and the filters let all words and pairs through."""
    rows = some_rows(9)
    want = brute(rows, 4, 5, 300)
    monkeypatch.setattr(phrases, "HOT", 10**6)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mined(spark, rows, least=4, top=300, filter_bits=64) == want
        monkeypatch.setattr(phrases, "HOT", 0)
        assert mined(spark, rows, least=4, top=300, filter_bits=64) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_share_of_the_longer_phrase(spark):
    rows = [("a b c", "en")] * 8 + [("a b", "en")] * 2 + [("b c", "en")]
    assert mined(spark, rows, least=2, percent=80) == brute(rows, 2, 5, 2000, 80)
    assert [r[2] for r in mined(spark, rows, least=2, percent=80)] == ["a b c"]
    assert len(mined(spark, rows, least=2)) == 3


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_pairs_send_no_windows(spark, monkeypatch):
    """Pairs are told by their words' keys; a window holds a run of three at least, so pairs that become frequent in more text make none."""
    rng = random.Random(51)
    rows = [(" ".join(rng.choice("abcdefghijkl") for _ in range(100)) + ". new york city.", "en") for _ in range(100)]
    made, windows = [], phrases.windows

    def counted(*args):
        made.append(windows(*args).cache())
        return made[-1]

    monkeypatch.setattr(phrases, "windows", counted)
    got = mined(spark, rows, least=60)
    assert got == brute(rows, 60, 5, 2000) and len([r for r in got if r[2].count(" ") == 1]) > 50
    assert {r.window for r in made[0].collect()} == {"new york city "}


def test_words_with_one_key_are_keyed_anew(spark, monkeypatch):
    """With the first seed all words of a language have one key."""
    real = phrases._hashes
    monkeypatch.setattr(phrases, "_hashes", lambda values, seed: real(values, seed) if seed else real(values, 0) * 0)
    rows = some_rows(3)
    assert mined(spark, rows, least=3) == brute(rows, 3, 5, 2000)
