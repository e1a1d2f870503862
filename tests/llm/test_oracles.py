"""Every query of the subpackage that has SQL, against DuckDB over the given tables."""

import duckdb
import pytest
from conftest import TESTDATA, duck_views
from helpers import assert_same

from panelscope.llm.queries import ORACLE_SQL, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    duck_views(con, SF)
    assert_same(QUERIES[key](spark, SF), con.sql(ORACLE_SQL[key]), check_types=False)
