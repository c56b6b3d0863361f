"""Every registered query against its SQL on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from conftest import SF
from workload.queries import QUERIES

TABLES = ["documents", "labels", "conversations", "pages"]
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(names, values):
    at = [names.index(n) for n in sorted(names)]
    key = lambda t: tuple((v is not None, str(v)) for v in t)
    return sorted((tuple(v[i] for i in at) for v in values), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = spark_entry.queries()[name](spark, SF)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == ordered(names, result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) <= set(spark_entry.queries()) and set(QUERIES) <= set(ORACLES)


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["source", "total", "positif", "negatif", "neutre"] and df.count() > 0
