"""Every query with SQL, against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    result = check_oracle.compare(spark, duck, name, SF)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, duck, name):
    assert check_oracle.compare(spark, duck, name, SF).startswith("rows")


def test_entry(spark):
    assert entry.entry(spark).count() == 2
