"""The audit against SQL, whatever the sketch; odd rows and counts of any size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sievemill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def by_sql(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?)", rows)
    return sorted(c.execute(divergence.ORACLE_SQL).fetchall())


def odd_rows():
    rows = [(i, f"Alpha beta x{i % 3}y ÉTÉ été\0Z\x7f9 {'common ' * (i % 4)}" + ("only" if i % 2 else "ONLY' 　wide　"), "en", f"s{i % 3}", "t", 1) for i in range(40)]
    rows += [(None, "alpha common", None, None, "t", 1)] * 12 + [(1, None, None, "s1", "t", 1), (2, "", "fr", "s0", "t", 1), (3, "12 ..", "fr", None, "t", 1)]
    rows += [(4, "alone " * 9, "de", "s0", "t", 1)] + [(5, "tie tie2 word " * 3, "es", s, "t", 1) for s in "abcde" * 3] + [(6, "b " * 50_000, "es", "a", None, None)]
    return rows


@pytest.mark.parametrize("width,held", [(1 << 14, 900_000), (8, 900_000), (1 << 14, 5)])
def test_as_sql(spark, monkeypatch, width, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.divergence(docs, width=width)
    assert sorted(map(tuple, got.collect())) == by_sql(rows)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA), width=1 << 10).collect() == []


def test_sketch_drops_rare_terms_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, f"often rare{i:c}" if i > 200 else "often", "en", "s", None, None) for i in range(97, 400)], SCHEMA)
    rows = divergence.counted(docs, min_docs=10)
    assert [(r.source, r.term, r.n) for r in rows.orderBy("source", "term").collect()] == [(None, "often", 303), ("s", None, 0), ("s", "often", 303)]


def test_shares_of_large_counts(spark):
    df = spark.range(1).select(F.lit(10**13).alias("n"), F.lit(3 * 10**15).alias("total"), F.lit(10**9).alias("size"))
    assert df.select(divergence._share("n", "total", "size").alias("p")).first().p == 1 + 10**9 * (10**13 + 2) // (3 * 10**15 + 2 * 10**9)
