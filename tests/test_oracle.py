"""Every registered query with an oracle equals DuckDB on the small tables."""

import pytest

import __spark_entry__ as entry
from winnow.plans.oracle import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    same_cols, same, ns, nd = compare(df, con, SQL[name])
    assert same_cols, (df.columns,)
    assert same, (name, ns, nd)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].rows > 0


def test_every_query_has_a_registered_callable():
    qs = entry.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 50
