"""Queries with an SQL twin against it, on the smallest tables."""

import duckdb
import pytest

from ledgerweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))
