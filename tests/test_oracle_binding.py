"""Every registered report against its DuckDB oracle over the driver's test tables
(sf0.001 here; tools/compare.py runs the same check at any scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import TESTDATA, duck_views
from helpers import assert_same
from panelscope.plans.reports import REPORTS

SF = f"{TESTDATA}/sf0.001"
KEYS = sorted(REPORTS)  # tests/llm has those of its own queries


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    duck_views(c, SF)
    return c


def test_every_report_has_an_oracle():
    assert set(REPORTS) <= set(E.queries()) and set(REPORTS) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_report_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    assert_same(df, con.sql(E.oracle_sql()[key]))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_idp_arrivals" in df.columns
