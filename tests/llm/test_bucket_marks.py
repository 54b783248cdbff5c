"""Marks of paragraphs dismiss no pair that reaches the threshold and most others; tables on the way give their disk back."""

import random
import time

from helpers import shingles
from ledgerweave.llm import near_dedup, substring_dedup
from ledgerweave.session import durable
from pyspark.sql import functions as F


def members(spark, texts):
    """rep, n, m0, m1 of texts that are one paragraph each."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = F.max_by(F.struct("n", "m0", "m1"), F.col("ce") - F.col("cs")).alias("u")
    return substring_dedup.paragraphs(docs).where("m0 is not null").groupBy(F.col("doc_id").alias("rep")).agg(whole).select("rep", "u.*")


def similar_texts(rng, n, changes):
    base = [[f"v{rng.randrange(10**6)}" for _ in range(rng.randint(30, 58))] for _ in range(4)]
    out = []
    for i in range(n):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, changes)):
            words[rng.choice([0, 1, len(words) - 1, rng.randrange(len(words))])] = f"z{rng.randrange(10**6)}"
        if i % 5 == 0:
            words = words[len(words) // 2 :] + words[: len(words) // 2]
        out.append(" ".join(words))
    return out


def test_marks_keep_every_pair_that_reaches_the_threshold(spark):
    texts = similar_texts(random.Random(51), 60, 4)
    sets = [shingles(t, substring_dedup.SHINGLE) for t in texts]
    rows = members(spark, texts)
    assert {r.rep: r.n for r in rows.collect()} == {i: len(s) for i, s in enumerate(sets)}
    entries = rows.select("*", F.lit(7).cast("long").alias("band"), F.col("rep").alias("comp"))
    got = {tuple(r) for r in near_dedup.bucket_pairs(entries, 80).collect()}
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    close = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 50 < len(close) and close <= got
    far = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) < 60 * len(sets[a] | sets[b])}
    assert len(got & far) < 0.02 * len(far)


def test_small_and_large_buckets_give_the_components_of_brute_force(spark, monkeypatch):
    rng = random.Random(52)
    texts = similar_texts(rng, 48, 3)
    sets = [shingles(t, substring_dedup.SHINGLE) for t in texts]
    root = list(range(48))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(48):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in range(48)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = members(spark, texts).select("*", F.lit(1).alias("w"), F.lit(7).cast("long").alias("band"))
    for small in (5, 100):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = {r.node: r.component for r in near_dedup.linked(entries, docs, substring_dedup.SHINGLE, 80).collect()}
        assert {i: got.get(i, i) for i in range(48)} == want


def test_paragraphs_that_overlap_need_no_texts(spark, monkeypatch):
    """Windows over one run of words share buckets but are far from the threshold: no pair of them is looked up, no shingle is dealt out."""
    rng = random.Random(53)
    run = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(run[i : i + 40]) for i in range(0, 60, 14)]
    formed, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: formed.append(pairs.where("a <> b").count()) or verified(pairs, *rest))
    monkeypatch.setattr(near_dedup, "common_shingles", lambda *_: 1 / 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = members(spark, texts).select("*", F.lit(1).alias("w"), F.explode(F.array(*[F.lit(x).cast("long") for x in (7, 8)])).alias("band"))
    assert near_dedup.linked(entries, docs, substring_dedup.SHINGLE, 80).count() == 0
    assert formed and sum(formed) == 0


def test_shuffle_files_go_once_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in (str(f) for f in disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in x}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    table = durable(spark.range(10_000).groupBy((F.col("id") % 100).alias("g")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 100 and spark.conf.get(name) == was
