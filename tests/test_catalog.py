"""Every query of the engine against its oracle, on the smallest data."""

import datetime
import os

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def same(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got.collect(), got.columns) == same(want.fetchall(), want.columns)


def test_queries_without_oracle_return_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
