"""Every query against its SQL, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _sorted, unlike_types

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    result = con.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(df.columns)
    assert unlike_types(df, result) == []
    assert _sorted(got, df.columns) == _sorted(result.fetchall(), result.columns)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row.total_logs, row.errors, row.security_issues, row.hardware_issues) == (1000, 250, 125, 189)
