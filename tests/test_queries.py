"""Every query with SQL gives the rows of that SQL; every other one runs."""

import os

import duckdb
import pytest

from sievemill.plans import registry

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, found.fetchall())
        assert len(got) == len(want)
        assert got == want
    assert got
