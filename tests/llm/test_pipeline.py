"""The stages against their operators' contracts on the smallest tables."""

import corpus_pipeline
from helpers import documents, near_components, text_metrics
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_near_stage_by_rows(spark):
    """Repeated rows, one id with two texts and rows without an id: one row of each group stays."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a, "s"), (3, a, "s"), (3, b, "s"), (None, b, "s"), (None, a + " more", "s"), (1, a, "s"), (9, None, "s"), (8, "", None)]
    got = corpus_pipeline.near(spark, documents(spark, rows), SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, a), (3, b), (9, None), (8, "")} and len(got) == 4


def test_run_equals_the_stages(spark):
    """run() gives what the stages give one by one, each held against brute force below."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.n_tokens, r.decoded) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    passed = {r.doc_id: r.text for r in kept.collect()}
    for r in docs.collect():
        n, _, symbols, _, repeated = text_metrics(r.text)
        if n < 50 or 2 * repeated > n or symbols * 10 > n:
            assert r.doc_id not in passed
    assert len(passed) > 0.5 * docs.count()

    lines = corpus_pipeline.lines(spark, kept, SF)
    assert lines.columns == docs.columns and lines.count() == len(passed)
    near = corpus_pipeline.near(spark, lines, SF)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    want, _ = near_components(rows, 5)
    ids = {r.doc_id for r in near.collect()}
    assert ids == set(want.values())

    mixed = corpus_pipeline.mixed(spark, near, SF)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    tokens = corpus_pipeline.tokens(spark, mixed, SF)
    assert tokens.count() == mixed.count() and tokens.where("n_tokens <> size(ids)").count() == 0
