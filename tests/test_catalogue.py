"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in catalogue.ORACLE:
        rel = duck.sql(catalogue.ORACLE[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(canon(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
