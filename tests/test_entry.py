"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools_check import compare
from trawler.sources.tables import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_names_match():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    report = compare(spark, con, SF_DIR, name)
    assert report.startswith(("OK", "ROWS")), report
