import duckdb
import pytest

import __spark_entry__
from ledgerweave.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    rel = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    norm = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([tuple(norm(r[c]) for c in cols) for r in rows], key=key) == sorted([tuple(norm(r[i]) for i in at) for r in rel.fetchall()], key=key)
