"""Every registered query next to its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    base = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


def _rows(table):
    names = sorted(table.column_names)
    return sorted(repr([row[name] for name in names]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    found = contract.queries()[name](spark, SF_DIR).toArrow()
    wanted = tables.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert _rows(found) == _rows(wanted)


def test_entry(spark):
    assert contract.entry(spark).count() == 150
