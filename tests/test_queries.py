"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tickbasin import oracles, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert queries.queries().keys() == oracles.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
