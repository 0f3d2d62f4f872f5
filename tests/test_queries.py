import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans import oracles
from tidemark.plans import queries as registry
from tools.check_oracle import TABLES, compare

@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in registry.QUERIES])
def test_query_agrees_with_sql(spark, db, sf_dir, name):
    ok, note = compare(spark, db, name, sf_dir)
    assert ok, note


def test_every_sql_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(oracles.ORACLES) == set(registry.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 1500
