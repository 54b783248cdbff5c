"""Cross-tokenizer alignment against the libraries on whole texts and a plain sweep over sets of offsets."""

import base64
import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from ledgerweave.llm import token_alignment as ta
from ledgerweave.llm.queries import model_path
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, row long, packed string, start int"


@pytest.fixture(scope="module")
def sides():
    return ta.byte_level(model_path("byte_bpe_50k.json")), ta.piece_level(model_path())


def brute(rows, sides):
    a, b = Tokenizer.from_file(model_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=model_path())
    a.encode_special_tokens = True
    # Token bytes by the libraries' own forms, not by the operator's tables.
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(model_path("byte_bpe_50k.tiktoken"), "rb"))}
    ranks[50256] = b"<|endoftext|>"
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        x_bytes, y_bytes = [ranks[i] for i in x], [piece(i) for i in y]
        if not text or b"".join(x_bytes) != (" " + text).encode() or b"".join(y_bytes) != (" " + text).encode():
            docs.append((doc, [], [], []))
            continue
        ends_x, ends_y = list(accumulate(map(len, x_bytes))), list(accumulate(map(len, y_bytes)))
        common = sorted(set(ends_x) & set(ends_y))
        groups = [[[], []] for _ in common]
        for side, ids, ends in ((0, x, ends_x), (1, y, ends_y)):
            for i, e in zip(ids, ends):
                groups[next(k for k, c in enumerate(common) if e <= c)][side].append(i)
        docs.append((doc, x, y, groups))
    links = [Counter((i, j) for g in d[3] for i in g[0] for j in g[1]) for d in docs]
    held = Counter(p for x in links for p in x)
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc, x, y, groups), linked in zip(docs, links):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc, len(x), len(y), len(groups), sum(linked.values()), sum(n for p, n in linked.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in linked.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def texts():
    rng = random.Random(12)
    parts = ["hello", "World", "straße", "言葉の", "naïve", "<|endoftext|>", "</s>", "<unk>", "x1y2", "don't", "😀", "\u0000", "é", "é", "ﬁ", "1234567", "--", "qzx" * 3, " ", " z"]
    marks = [" ", " ", " ", " ", "  ", "\n", "\t", ".", " \n ", "\r\n", "\n\n ", "   "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(marks) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(i, " ".join(rng.choice(parts[:5] + parts[9:12]) for _ in range(30))) for i in range(100, 130)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  two"), (204, "a▁b"), (205, "end "), (206, "\nline"), (None, "no id"), (None, "no id"), (5, "same id"), (5, "same id"), (207, "<s> [INST]")]
    return rows + [(300, "".join(rng.choice("abcdefghij") for _ in range(3000))), (301, "ab" * 2000), (302, "言" * 700 + " " + "z" * 900)]


def aligned(spark, rows, sides, **options):
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], DOCS)
    return sorted((tuple(r) for r in ta.align(docs.repartition(3), *sides, **options).collect()), key=str)


def test_equals_the_libraries(spark, sides):
    rows = texts()
    assert aligned(spark, rows, sides) == brute(rows, sides)


def test_small_blocks_slices_and_head(spark, sides, monkeypatch):
    """Documents over many blocks and batches, links formed a few at a time, most pairs met by the join."""
    rows = texts()
    monkeypatch.setattr(ta, "BLOCK", 7)
    monkeypatch.setattr(ta, "SLICE", 11)
    monkeypatch.setattr(ta, "CACHE_WORDS", 20)
    monkeypatch.setattr(ta, "BUCKETS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert aligned(spark, rows, sides, head=40) == brute(rows, sides)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_threshold_keeps_the_head_small(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 9 + [3] * 8 + [4] * 3 + [1000])], "pair long, n long")
    assert [ta.head_threshold(counts, m) for m in (0, 1, 3, 4, 20, 21, 70, 71)] == [1024, 8, 8, 4, 4, 2, 2, 1]


def test_empty_table(spark, sides):
    assert aligned(spark, [], sides) == []
