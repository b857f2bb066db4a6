"""Every query with an oracle equals DuckDB on the small driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert "exact" in line or "close" in line, line


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["WentQuiet", "customers", "churned", "churn_rate"]
