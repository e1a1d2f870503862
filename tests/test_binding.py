"""The Spark binding of the test tables equals the independent SQL binding, table by
table and column by column; the views are queryable through spark.sql."""

import duckdb
import pytest

from conftest import TESTDATA, duck_views
from helpers import assert_same
from panelscope.plans.oracle import BINDING_SQL
from panelscope.plans.views import register_views
from panelscope.sources.binding import derive, tables_for
from panelscope.sources.schema import TABLE_NAMES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    duck_views(c, SF)
    return c


@pytest.mark.parametrize("name", TABLE_NAMES)
def test_derived_table_equals_sql_binding(spark, con, name):
    assert_same(derive(spark, SF)[name], con.sql(f"WITH {BINDING_SQL} SELECT * FROM {name}"))


@pytest.mark.parametrize("name", TABLE_NAMES)
def test_materialised_table_equals_derivation(spark, con, name):
    assert_same(tables_for(spark, SF)[name], con.sql(f"WITH {BINDING_SQL} SELECT * FROM {name}"))


def test_materialised_hierarchy_map(spark, con):
    t = tables_for(spark, SF)
    assert t.geo is not None
    want = con.sql(
        f"WITH {BINDING_SQL} SELECT s.settlement_id, d.district_id, p.province_id FROM settlements s "
        "JOIN districts d ON s.adm2_code = d.adm2_code JOIN provinces p ON d.province_id = p.province_id"
    )
    assert_same(t.geo, want)


def test_views_through_spark_sql(spark):
    t = tables_for(spark, SF)
    register_views(t)
    rows = spark.sql("SELECT round_id, total_idp_arrivals FROM vw_national_dashboard ORDER BY round_id").collect()
    assert [r.round_id for r in rows] == [1, 2, 3, 4, 5, 6]
    n = spark.sql("SELECT COUNT(*) AS n FROM vw_observations_full WHERE round_id = 6").first().n
    assert n == t.observations.where("round_id = 6").count()


def test_reports_as_sql_views(spark):
    from panelscope.plans.reports import REPORTS
    from panelscope.plans.views import register_reports

    t = tables_for(spark, SF)
    names = register_reports(t)
    assert len(names) == len(REPORTS)
    got = spark.sql("SELECT province_name, total_idp_arrivals FROM report_q2a_province_burden").collect()
    want = REPORTS["q2a_province_burden"](t).select("province_name", "total_idp_arrivals").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_every_order_is_in_the_panel(spark):
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    customers = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"))
    want = orders.join(customers, "o_custkey", "left_semi").agg(F.sum(F.floor(F.col("o_totalprice") / 500.0))).first()[0]
    t = tables_for(spark, SF)
    assert t.observations.agg(F.sum("idp_arrivals")).first()[0] == want
    assert t.unit_key_bounded is True


def test_rewritten_input_is_read_again(spark, tmp_path):
    for name in ("nation", "customer", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = tables_for(spark, str(tmp_path))
    assert tables_for(spark, str(tmp_path)) is first
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert tables_for(spark, str(tmp_path)) is not first


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from panelscope.sources.tables import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_rows_are_made_after_the_explode(spark):
    # An array of whole rows is too large an expression to be compiled; the sums are exploded.
    shown = "spark.sql.debug.maxToStringFields"
    old = spark.conf.get(shown)
    spark.conf.set(shown, "1000")
    try:
        plan = derive(spark, f"{TESTDATA}/sf0.001").observations._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(shown, old)
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(exploded) == 1 and "n_conf" in exploded[0], plan
    assert "conflict_res_1" not in exploded[0] and "change_idp_arrivals" not in exploded[0], exploded[0]
