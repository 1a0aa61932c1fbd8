"""Every registered query gives what its SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from lanternrank.registry import oracle, registered

TABLES = "embeddings documents benchmark conversations pages labels".split()


@pytest.fixture(scope="module")
def sql(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def normal(value):
    return format(value, ".6f") if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(oracle.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, sql, name):
    df = entry.queries()[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in cursor.fetchall())
    assert got


def test_entry(spark, tables):
    row = entry.entry(spark).first()
    assert row.queries > 0
    assert 0 <= row.mrr_at_1 == row.hit_at_1 <= row.mrr_at_5 <= row.hit_at_5 <= 1
    assert row.mrr_at_5 <= row.mrr_at_1000 <= 1
