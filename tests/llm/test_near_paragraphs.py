"""Near paragraphs of different documents against brute force: changed openings, insertions and swapped halves in texts of their own."""

import random

from helpers import documents, shingles
from ledgerweave.llm import substring_dedup


def prose_of(rng, n):
    return [f"v{rng.randrange(10**9)}" for _ in range(n)]


def near(rng, words, kind):
    """A copy of at least similarity 0.8: new first words, a word put in the middle, halves swapped, or new first and last words."""
    words, half = list(words), len(words) // 2
    fresh = lambda: f"z{rng.randrange(10**9)}"
    if kind == 0:
        words[:2] = fresh(), fresh()
    elif kind == 1:
        words.insert(half, fresh())
    elif kind == 2:
        words = words[half:] + words[:half]
    else:
        words[0], words[-1] = fresh(), fresh()
    return words


def test_pairs_with_other_openings_are_linked(spark):
    rng = random.Random(31)
    rows = []
    for i in range(80):
        words = prose_of(rng, {1: 46, 2: 41}.get(i % 4, 58))
        for copy in (words, near(rng, words, i % 4)):
            rows.append((len(rows), "\n".join(map(" ".join, (prose_of(rng, 70), copy, prose_of(rng, 70)))), "s"))
    df = documents(spark, rows)
    units = substring_dedup.paragraphs(df.select("doc_id", "text")).where("bands is not null").collect()
    sets = {(u.doc_id, u.cs, u.ce): shingles(rows[u.doc_id][1][u.cs : u.ce], substring_dedup.SHINGLE) for u in units}
    clusters = {(r.doc_id, r.cs, r.ce): r.cluster for r in substring_dedup.repeated_passages(df).collect()}
    close = [(x, y) for x in sets for y in sets if x[0] < y[0] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    assert len({x[0] for x, _ in close}) == 80
    for x, y in close:
        assert x in clusters and clusters[x] == clusters.get(y)


def test_overlapping_paragraphs_of_one_text_are_no_copies(spark):
    """Short sentences begin paragraphs that share most words; text around a passage stays, however many such paragraphs reach into it."""
    rng = random.Random(32)
    short = lambda n: " ".join(f"{a} {b}." for a, b in (prose_of(rng, 2) for _ in range(n)))
    passage = short(40)
    rows = [(i, f"{short(60)} {passage} {short(60)}", "s") for i in range(2)]
    got = {r.doc_id: r for r in substring_dedup.op4_query(documents(spark, rows)).collect()}
    assert set(got) == {0, 1} and got[0].n_spans == 0
    a = rows[1][1].index(passage)
    (span,) = got[1].spans
    # A near paragraph may take in a fifth of its words beside the passage.
    assert a - 100 <= span.cs <= a + 20 and a + len(passage) - 20 <= span.ce <= a + len(passage) + 100
