"""Quality rules, mixing, line dedup, near and substring dedup against brute force."""

import random

import pytest
from helpers import documents, near_components, shingles, text_metrics
from pyspark.sql import functions as F

from ledgerweave.llm import components, line_dedup, mixing, near_dedup, quality_rules, substring_dedup

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(4000)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n\n \nx", "é\u00a0x\u2003y ß\t\x0b", "#*$ <|> %&", "\ud7ff \U0001f600 " * 30]
    texts += [prose(rng, rng.randint(0, 120), WORDS[:4]) for _ in range(40)] + ["a b\n" * 2000, prose(rng, 3000, WORDS)]
    return texts


def test_metrics(spark, odd_texts):
    df = documents(spark, [(i, t, "s") for i, t in enumerate(odd_texts)])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.with_text_metrics(df).drop("text").collect()}
    assert got == {i: text_metrics(t) for i, t in enumerate(odd_texts)}


def test_metrics_without_position_bits(spark, odd_texts, monkeypatch):
    """Texts with more words than positions have bits for are counted exactly; columns named like temporaries stay."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)
    df = documents(spark, [(i, t, "s") for i, t in enumerate(odd_texts)]).withColumns({"_words": F.lit("mine"), "_Keys": F.lit(7)})
    out = quality_rules.with_text_metrics(df)
    assert out.columns[:7] == df.columns
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r["_words"], r["_Keys"]) for r in out.drop("text").collect()}
    assert got == {i: (*text_metrics(t), "mine", 7) for i, t in enumerate(odd_texts)}


def test_judge(spark):
    rng = random.Random(1)
    rows = [(0, prose(rng, 200), "s"), (1, " ".join(w + "###" for w in prose(rng, 200).split()), "s"), (2, "short", "s"), (3, None, "s"), (4, "a b c " * 100, "s"), (0, prose(rng, 100), None)]
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge(documents(spark, rows)).collect())
    assert got == [(0, False, True), (0, False, True), (1, False, False), (2, True, False), (3, True, False), (4, True, False)]
    assert quality_rules.judge(documents(spark, rows).limit(0)).count() == 0


def test_cascade_order_changes_cost_only(spark):
    df = documents(spark, [(i, "### " * 30 + f"w{i} " * 30, "s") for i in range(4)])
    rules = quality_rules.metric_rules()
    measured = quality_rules.durable(quality_rules.with_text_metrics(df))
    ordered = quality_rules.plan_cascade(measured, rules)
    assert ordered[0].name == "symbols"
    for order in (ordered, ordered[::-1]):
        assert measured.where(quality_rules.cascade(order).isNull()).count() == 0


def test_cascade_is_planned_by_measured_cost(spark):
    """Of two rules that reject alike the faster comes first; of two that cost alike the one that rejects more."""
    df = documents(spark, [(i, f"w{i} " * 3000, "s") for i in range(20)])
    measured = quality_rules.durable(quality_rules.with_text_metrics(df))
    slow = quality_rules.Rule("slow", F.regexp_count("text", F.lit("(w[0-9]+ )+?w[0-9]+ w")) >= 0)
    fast = quality_rules.Rule("fast", F.col("n_words") > 0)
    half = quality_rules.Rule("half", F.col("doc_id") < 10)
    never = quality_rules.Rule("never", F.lit(False))
    assert [r.name for r in quality_rules.plan_cascade(measured, [never, slow, half, fast])][:2] == ["fast", "half"]
    assert [r.name for r in quality_rules.plan_cascade(measured.limit(0), [slow, fast])] == ["slow", "fast"]


def brute_mix(rows):
    """Water filling by rounds, then prefixes of the rows in hash order."""
    import hashlib

    size = lambda t: len((t or "").split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    out = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, used = int(target[s] - whole * total[s]), 0
        for h, group in sorted(((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i in {i for i, _, x in rows if x == s})):
            tokens = sum(size(t) for i, t, x in rows if x == s and i == group)
            extra = used + tokens <= budget
            used += tokens if extra else budget + 1
            for i, t, x in rows:
                if x == s and i == group:
                    out[i, x] = (target[s], (whole + extra) * size(t) if total[s] else 0)
    return out


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["b", "a", "ü", None, "z"])) for i in range(150)] + [(900, None, "empty"), (901, "", "empty"), (902, prose(rng, 5000), "a")]
    got = mixing.mix(documents(spark, rows)).collect()
    want = brute_mix(rows)
    assert len(got) == len(rows)
    for r in got:
        target, taken = want[r.doc_id, r.source]
        assert r.target == pytest.approx(target) and r.taken == taken and r.taken <= 2 * r.size
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0


def test_mix_without_ids(spark):
    """Rows with one id or none are told apart by their texts, so the source's target is met."""
    rng = random.Random(31)
    rows = [(None, prose(rng, 100), "a") for _ in range(100)] + [(7, prose(rng, 50), "b") for _ in range(100)] + [(i, prose(rng, 20), "c") for i in range(100)]
    got = mixing.mix(documents(spark, rows), keep=("size", "n_chars")).collect()
    assert len(got) == 300 and all(r.taken <= 2 * r.size for r in got)
    for s in "abc":
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), abs=100)


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = (text or "").split("\n"), set()
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if not "".join(key).strip(" \t\n\x0b\x0c\r"):
                continue
            if key in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(key)
        out[i] = (0 if text is None else len(lines), len(gone), None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "long line"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x\ny"), (103, "\n\n\n\n"), (104, "same\n" * 500)]
    df = documents(spark, [(i, t, "s") for i, t in rows]).withColumns({c: F.lit("clash") for c in ("n_removed", "starts", "mark", "spread", "_spread", "row", "a.b")})
    done = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in done} == brute_lines(rows)
    assert {(r.starts, r.mark, r.spread, r["_spread"], r.row, r["a.b"]) for r in done} == {("clash",) * 6}


def test_line_dedup_without_ids(spark):
    """Rows that share an id or have none lose no line of their own to each other."""
    a, b = "x 1\nx 2\nx 3", "y 1\ny 2\ny 3\ny 4"
    rows = [(1, a), (None, a), (None, b), (5, b + "\nz"), (5, "q\nr\ns"), (5, "q\nr\ns")]
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in line_dedup.dedup_lines(documents(spark, [(i, t, "s") for i, t in rows])).collect())
    assert got == sorted([("1", 0, a), ("None", 3, ""), ("None", 4, ""), ("5", 0, b + "\nz"), ("5", 0, "q\nr\ns"), ("5", 0, "q\nr\ns")])


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, k):
    rng = random.Random(k)
    texts = [None, "", "  ", "one", "ONE", "one two three", "One two\nTHREE"]
    for size, changes in ((30, 2), (120, 6), (120, 14)):
        texts += variants(rng, prose(rng, size), 25, changes)
    texts += [prose(rng, 40) for _ in range(20)] + [texts[-1]] * 3
    rows = list(enumerate(texts))
    want, sets = near_components(rows, k)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), k).collect()}
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (want[i], len(sets[i]), want[i] == i) for i in want}


def test_near_dedup_empty_and_null_ids(spark):
    df = documents(spark, [(None, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "a b c d e", "s")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (None, None, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)] + [(200, 100)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links for n in (a, b) if a != b}


def sentences(rng, n):
    return " ".join(" ".join(f"v{rng.randrange(10**5)}" for _ in range(rng.randint(5, 14))).capitalize() + "." for _ in range(n))


def test_substring_dedup(spark):
    rng = random.Random(6)
    passage = [sentences(rng, 12) for _ in range(6)]
    rows, planted = [], set()
    for i in range(60):
        text = sentences(rng, 15)
        if i % 3 == 0:
            text = text + (" " if i % 2 else "\n") + passage[i // 3 % 6] + " " + sentences(rng, 4)
            planted.add(i)
        rows.append((i, text, "s"))
    rows += [(90, None, "s"), (91, "", "s"), (92, "too short. " * 2, "s"), (93, "word " * 4000, "s")]
    df = documents(spark, rows)
    got = {r.doc_id: r for r in substring_dedup.op4_query(df).collect()}
    assert set(got) == planted
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_passages(df).collect()}
    assert len(cleaned) == len(rows)
    for i, text, _ in rows:
        if i in planted and i // 3 % 6 != i // 3:
            assert 0 < got[i].removed_chars <= len(passage[i // 3 % 6]) + 1
            assert len(cleaned[i]) == len(text) - got[i].removed_chars and cleaned[i][:20] == text[:20]
        elif i not in planted:
            assert cleaned[i] == text
    assert substring_dedup.op4_query(df.limit(0)).count() == 0


def test_paragraphs_of_repeated_lines(spark):
    """Sizes are those of the distinct shingle sets, so that copies repeated more or less often meet."""
    rng = random.Random(12)
    line = prose(rng, 8)
    texts = [f"{line} " * 5 + "end.", f"{line} " * 7 + "end.", f"{prose(rng, 3)} " * 15, "a b " * 200, sentences(rng, 12) * 2, "x y z w.\n" * 30]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = substring_dedup.paragraphs(df.select("doc_id", "text")).collect()
    assert {r.doc_id for r in found} == set(range(len(texts)))
    assert found
    for r in found:
        assert r.n == len(shingles(texts[r.doc_id][r.cs : r.ce], substring_dedup.SHINGLE))
    whole = [i for i in (0, 1) if shingles(texts[i], 5) == shingles(texts[0], 5)]
    hits = {r.doc_id: r.cluster for r in substring_dedup.repeated_passages(df).collect() if (r.cs, r.ce) == (0, len(texts[r.doc_id]))}
    assert whole == [0, 1] and hits[0] == hits[1]


def test_short_passages_in_mid_text(spark):
    """Passages of 51 to 60 words are found without a whole paragraph in them, with and without punctuation."""
    rng = random.Random(21)
    rows, at = [], {}
    for i in range(60):
        words = prose(rng, 51 + i % 10, [f"p{j}" for j in range(10**5)])
        if i % 3 == 1:
            words = words.replace(" ", ". ", 1)
        elif i % 3 == 2:
            words = "\n".join(words.split(" ", 1))
        for copy in range(2):
            before, after = (prose(rng, rng.randint(30, 90), [f"q{j}" for j in range(10**6)]) for _ in range(2))
            at[2 * i + copy] = (len(before) + 1, len(before) + 1 + len(words))
            rows.append((2 * i + copy, f"{before} {words} {after}", "s"))
    got = {r.doc_id: r for r in substring_dedup.op4_query(documents(spark, rows)).collect()}
    assert set(got) == set(at)
    for i, (a, b) in at.items():
        assert got[i].keeper == i - i % 2
        assert got[i].n_spans == i % 2
        for s in got[i].spans:
            # Near paragraphs may take in some words beside the passage.
            assert min(s.ce, b) - max(s.cs, a) >= 100


def test_blocks_fall_alike_in_any_text():
    from ledgerweave.llm.token_arrays import split_words, word_hashes

    rng = random.Random(22)
    run = prose(rng, 40, WORDS)
    for passage in (run, "la " * 40, "a b " * 20):
        found = set()
        for _ in range(30):
            before = prose(rng, rng.randint(0, 50), WORDS)
            text = " ".join(f"{before} {passage} {prose(rng, rng.randint(0, 50), WORDS)}".split())
            words = split_words(substring_dedup.pa.array([text]), True, True)
            h = word_hashes(words)
            skip = len(before.split())
            inside = {int(x) - skip for x in substring_dedup._places(words, substring_dedup._shingles(h), substring_dedup.MIN_WORDS) if skip <= x <= skip + 40 - substring_dedup.MIN_WORDS}
            assert inside
            found.add(frozenset(inside))
        assert frozenset.intersection(*found)
