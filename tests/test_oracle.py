"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, normal


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    frame = duck.execute(entry.oracle_sql()[name])
    want = normal([d[0] for d in frame.description], frame.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
