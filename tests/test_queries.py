"""Every registered query with SQL equals it on the smallest tables; the others run."""

import pytest

from quern import command_queries, queries

QUERIES, ORACLES = queries.QUERIES | command_queries.QUERIES, queries.ORACLES | command_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(agree, name):
    agree(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_no_query_is_vacuous():
    """Every SQL yields rows on the tables of the comparison, and more than a lone zero."""
    import os

    import duckdb

    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    for name, sql in ORACLES.items():
        rows = con.sql(sql).fetchall()
        assert rows and rows != [(0,)], name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
