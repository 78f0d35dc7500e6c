"""Every driver query against its check SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from lapwise.sources.tables import TABLES, table_path


@pytest.fixture(scope="module")
def connection(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{table_path(sf_dir, table)}'")
    return connection


@pytest.mark.parametrize("key", sorted(contract.queries()))
def test_query(spark, connection, sf_dir, key):
    status, note, _ = compare(
        spark, connection, key, contract.queries()[key], contract.oracle_sql().get(key), sf_dir
    )
    assert status in ("ok", "rows-only"), note


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).count() > 0
