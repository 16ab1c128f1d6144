"""Every registered query of the library itself against its DuckDB twin at sf0.001."""

import pytest

import __spark_entry__ as entry
from staylens import plans
from tests.oracle_check import compare

# Fits a full forest alone, as train_and_select does beside the regression.
SLOW = {"train_rf"}


@pytest.mark.parametrize("key", [key for key in plans.queries() if key not in SLOW])
def test_query_matches_its_twin(spark, sf_dir, duckdb_tables, key):
    assert compare(spark, duckdb_tables, sf_dir, key) == ""


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
