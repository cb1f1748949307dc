import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewarp.plans import catalog, scratch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    want = duck.sql(catalog.ORACLES[name])
    with scratch.scope():
        df = catalog.QUERIES[name](spark, SF)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
