"""Every query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from lodeline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(str(tidy(r[i])) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
