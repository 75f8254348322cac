"""Every query with SQL gives the rows DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from modlens.registry import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows_of(names, records):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted(repr(tuple(0.0 if r[i] == 0 else r[i] for i in at)) for r in records)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(spark, folder, duck, name):
    query = QUERIES[name]
    df = query.run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(query.sql)
    names = [d[0] for d in cursor.description]
    assert got == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_runs_without_sql(spark, folder, name):
    assert QUERIES[name].run(spark, folder).count() > 0


def test_entry_points(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
