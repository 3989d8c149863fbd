"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from inkstream.plans import queries as own

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(str, frame[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(own.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(own.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert own.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views(spark):
    from inkstream import sql

    sql.register(spark, DIR, ["decision_summary", "segment_progress"])
    row = spark.sql("SELECT sum(s.kept + s.dropped) AS n, (SELECT count(*) FROM blocks) AS m FROM decision_summary s").first()
    assert row.n == row.m and spark.sql("SELECT max(progress) FROM segment_progress").first()[0] <= 100
