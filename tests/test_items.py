"""Header search, end of the items, columns, keyed rows, choices and names against rules written out step by step."""

import random
import re

import pytest
from ledgerweave.operators import extract, items, naming

LINES = "doc_id long, line int, text string, cx double, cy double, y0 double, y1 double"


def pages(seed, n=150):
    rng = random.Random(seed)
    words = ["", "", " ", "*办公*纸 12", "*餐饮*费", "*服务*咨询 3.5", "合计", "合", "计", "¥1 ￥2", "¥9", "大写 壹", "plain", "note 7", "收款人", "小 计", "项目名称 规格型号", "单 位 数量", "单价", "金额 税率", "税额", "数 量", "品名", "x"]
    rows = {}
    for d in range(n):
        y, out = 0.0, []
        for i in range(rng.randrange(1, 25)):
            y += rng.choice([0.0, 0.0, 1.0, 2.5, 6.0, 12.0])
            cx = rng.choice([10.0, 30.0, 55.0, 80.0, 120.0]) + rng.random()
            out.append((i, rng.choice(words), cx, y + 2.0, y, y + 4.0))
        rows[d] = out
    return rows


def frame(spark, docs):
    return spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], LINES)


def bounds_of(rows, eps=14.0):
    xs = sorted(r[2] for r in rows)
    groups = [[xs[0]]]
    for x in xs[1:]:
        if x - groups[-1][-1] > eps:
            groups.append([])
        groups[-1].append(x)
    centers = [sum(g) / len(g) for g in groups]
    return [(a + b) / 2 for a, b in zip(centers, centers[1:])]


def end_of(rows):
    texts = [r[1].strip() for r in rows]
    wanted = [i for i, r in enumerate(rows) if re.match(r"\*[^*]+\*", r[1]) and re.search(r"\d", r[1])]
    if not wanted:
        return None
    last = wanted[-1]
    for i in range(last + 2, len(rows)):
        if not texts[i] and not texts[i - 1]:
            return last, max(i - 2, last), "blank"
    total = next((r[4] for r, t in zip(rows, texts) if len(re.findall("[¥￥]", t)) >= 2), None)
    if total is None:
        for i, t in enumerate(texts):
            if t == "合":
                total = next((min(rows[i][4], rows[j][4]) for j in range(i + 1, min(i + 5, len(rows))) if texts[j] == "计" and abs(rows[i][3] - rows[j][3]) <= 3), None)
            elif "合计" in t:
                total = rows[i][4]
            if total is not None:
                break
    if total is not None:
        below = next((i for i in range(last, len(rows)) if rows[i][4] >= total - 1), None)
        return (last, len(rows) - 1, "last") if below is None else (last, max(below - 1, last), "total")
    run = 0
    for i in range(last + 1, len(rows)):
        if any(w in texts[i] for w in items.END_WORDS):
            return last, i - 1, "word"
        run = 0 if re.match(r"\*[^*]+\*", texts[i]) or re.search(r"\d", texts[i]) else run + 1
        if run >= 2:
            return last, i - 2, "plain"
    return last, len(rows) - 1, "last"


def header_of(rows, bounds):
    first = next((i for i, r in enumerate(rows) if re.match(r"\*[^*]+\*", r[1]) and re.search(r"\d", r[1])), None)
    if first is None:
        return None
    hits = []
    for i in range(max(0, first - 10), first):
        for k, p in enumerate(items.HEADER_PATTERNS):
            if re.search(p, rows[i][1]):
                hits.append((rows[i][3], i, k, sum(b <= rows[i][2] for b in bounds) if bounds else -1))
    hits.sort(key=lambda h: h[0])
    groups = []
    for h in hits:
        if groups and abs(h[0] - groups[-1][0][0]) <= 5.0:
            groups[-1].append(h)
        else:
            groups.append([h])
    lines = []
    for g in groups:
        order = [h[2] for h in sorted((h for h in g if h[3] >= 0), key=lambda h: h[3])]
        if len({h[2] for h in g}) >= 3 and sum(a > b for a, b in zip(order, order[1:])) <= 1:
            lines += [h[1] for h in g]
    return (min(lines), max(lines)) if lines else None


def test_columns_header_and_end(spark):
    docs = pages(3) | {900: [(0, "*a*b 1", 5.0, 2.0, 0.0, 4.0)], 901: [(0, "no item", 5.0, 2.0, 0.0, 4.0)]}
    df = frame(spark, docs)
    got = items.column_bounds(df)
    bounds = {r.doc_id: list(r.bounds) for r in got.collect()}
    assert set(bounds) == set(docs)
    for d, rows in docs.items():
        assert bounds[d] == pytest.approx(bounds_of(rows))
    ends = {r.doc_id: (r.last_item, r.item_end, r.ended_by) for r in items.item_ends(df).collect()}
    assert ends == {d: e for d, rows in docs.items() if (e := end_of(rows))}
    assert {e[2] for e in ends.values()} == {"blank", "total", "word", "plain", "last"}
    for given, known in ((got, bounds), (None, {})):
        heads = {r.doc_id: (r.header_first, r.header_last) for r in items.header_ranges(df, given).collect()}
        assert heads == {d: h for d, rows in docs.items() if (h := header_of(rows, known.get(d)))} and len(heads) > 5
    assert items.item_ends(df.limit(0)).count() == items.header_ranges(df.limit(0), got).count() == 0


def test_keyed_rows(spark):
    cells = [(1, 0, 0, "纸 张\n1"), (1, 0, 1, "2"), (1, 0, 2, "3.5"), (1, 0, 3, "7 "), (1, 0, 4, "13%"), (1, 0, 5, ""), (1, 1, 0, "笔"), (1, 1, 3, "9"), (2, 0, 0, "a"), (2, 0, 1, ""), (2, 0, 2, "c"), (3, 0, 0, " ")]
    heads = [(1, ["品名", "单价", "数量", "金额", "税率", "税额"]), (2, ["A", "B", "单位"]), (3, ["A"])]
    got = items.keyed_rows(spark.createDataFrame(cells, "doc_id long, row int, col int, text string"), spark.createDataFrame(heads, "doc_id long, headers array<string>")).collect()
    assert {(r.doc_id, r.row): r.fields for r in got} == {
        (1, 0): {"项目名称": "纸张1", "数量": "3.5", "单价": "2", "金额": "7", "税率/征收率": "13%"}, (1, 1): {"项目名称": "笔", "数量": "", "单价": "", "金额": "9", "税率/征收率": ""},
        (2, 0): {"A": "a", "单位": "c"}, (3, 0): {},
    }


def test_even_bounds(spark):
    assert spark.range(1).select(items.even_bounds(items.F.lit(0.0), items.F.lit(80.0))).first()[0] == [10.0 * i for i in range(1, 8)]


def test_choices_in_order_of_arrival(spark):
    rng = random.Random(8)
    rows = []
    for d in range(80):
        for pos in range(rng.randrange(1, 14)):
            rows.append((d, pos, rng.choice(["no", "buyer", "seller", "tax"]), rng.choice(["", "x", "y", "z", None]), float(rng.randrange(3)), rng.choice([0.5, 0.7]), rng.sample(range(6), rng.randrange(0, 3))))
    rules = (("no", "tax"), ("buyer", "seller"), ("tax", "buyer"))
    want = {}
    for d in range(80):
        fields = {}
        for r in (r for r in rows if r[0] == d and r[3]):
            fields.setdefault(r[2], []).append(r)
        chosen = {f: sorted(c, key=lambda r: -r[5])[0] for f, c in fields.items()}
        for value in {r[3] for r in chosen.values()}:
            same = sorted((f for f in chosen if chosen[f][3] == value), key=lambda f: -chosen[f][4])
            for f in same[1:]:
                del chosen[f]
        for a, b in rules:
            if a in chosen and b in chosen and set(chosen[a][6]) & set(chosen[b][6]):
                del chosen[b if chosen[a][4] >= chosen[b][4] else a]
        want |= {(d, f): (r[3], r[4], r[5], r[6]) for f, r in chosen.items()}
    df = spark.createDataFrame(rows, "doc_id long, pos int, field string, value string, score double, confidence double, tokens array<int>")
    got = {(r.doc_id, r.field): (r.value, r.score, r.confidence, r.tokens) for r in extract.resolved_in_order(df.repartition(3), rules).collect()}
    assert got == want
    kept = {}
    for d in range(80):
        taken = set()
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], r[1])):
            if not taken & set(r[6]):
                taken |= set(r[6])
                kept[d, r[1]] = True
    assert {(r.doc_id, r.pos) for r in extract.disjoint(df).collect()} == set(kept)


def test_names_never_meet(spark):
    rng = random.Random(2)
    names = ["a.pdf", "a_1.pdf", "a_1_1.pdf", "a_2.pdf", "b", "b_1", ".rc", ".rc_1", "only.txt", None, "", "c.tar.gz", "c.tar_1.gz"]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(names)) for i in range(400)]
    want = {}
    for box in ("x", "y", None):
        used = set()
        for i, _, name in (r for r in rows if r[1] == box):
            name = name or ""
            dot = name.rfind(".")
            base, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            final, k = name, 1
            while final in used:
                final, k = f"{base}_{k}{ext}", k + 1
            used.add(final)
            want[i] = final
    got = naming.archive_names(spark.createDataFrame(rows, "pos long, box string, name string").repartition(4), ["box"]).collect()
    assert {r.pos: r.final_name for r in got} == want
    three = spark.createDataFrame([(0, "x", "a.pdf"), (1, "x", "a.pdf"), (2, "x", "a_1.pdf")], "pos long, box string, name string")
    assert [r.final_name for r in naming.archive_names(three, ["box"]).orderBy("pos").collect()] == ["a.pdf", "a_1.pdf", "a_1_1.pdf"]


def test_anchors(spark):
    rng = random.Random(5)
    words = ["购买方", "购买方信息", "的购买方信息", "销方", "销售方:", "项目名称", "服务名称", "货物或应税劳务、服务名称", "合计", "价税合计 5", "备注", "备注:x", "一备注", "收款人", "x", ""]
    rows = [(d, i, rng.choice(words)) for d in range(60) for i in range(rng.randrange(1, 12))]
    want = {}
    for d in range(60):
        for name, (whole, patterns) in items.ANCHORS.items():
            found = [(i, t) for e, i, t in rows if e == d and any(re.search(p, t) for p in patterns)]
            if found:
                full = [f for f in found if whole and any(re.fullmatch(p, f[1]) for p in patterns)]
                want[d, name] = (full or found)[0]
    got = items.anchors(spark.createDataFrame(rows, "doc_id long, pos int, text string").repartition(3)).collect()
    assert {(r.doc_id, r.anchor): (r.pos, r.text) for r in got} == want


def test_orphans_go_to_their_data_line(spark):
    rng = random.Random(9)
    words = ["*a*b", "*a*b 12.00", "7.50", "name", "more", "x y", "#", "odd1"]
    rows = [(d, i, rng.choice(words)) for d in range(200) for i in range(rng.randrange(1, 16))]
    data, noise, starts, only = (lambda t: "." in t), (lambda t: t == "#"), (lambda t: t.startswith("*")), (lambda t: t != "odd1")
    want = []
    for d in range(200):
        out, waiting = [], []
        for i, t in ((i, t) for e, i, t in rows if e == d):
            if starts(t) and waiting and out:
                out[-1][1] += " " + " ".join(waiting)
                waiting = []
            if data(t):
                out.append([i, " ".join([*waiting[-4:], t])])
                waiting = []
            elif not noise(t):
                waiting.append(t)
        if out:
            out[-1][1] = " ".join([out[-1][1], *[t for t in waiting if only(t)]])
            want += [(d, *o) for o in out]
        else:
            want += [(d, None, t) for t in waiting]
    text = items.F.col("text")
    df = spark.createDataFrame(rows, "doc_id long, line int, text string")
    got = items.carried_orphans(df, text.contains("."), text == "#", text.startswith("*"), text != "odd1").collect()
    own = {d for d, i, _ in want if i is None}
    assert sorted((r.doc_id, None if r.doc_id in own else r.line, r.text) for r in got if r.doc_id not in own) == sorted(w for w in want if w[0] not in own)
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id in own) == sorted((d, t) for d, i, t in want if i is None) and len(own) > 3
