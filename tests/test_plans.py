"""Plan and schema assertions on the registered reports (sf0.001 tables)."""

import re

import pytest

import __spark_entry__ as E
from conftest import TESTDATA
from panelscope.plans.reports import REPORTS

SF = f"{TESTDATA}/sf0.001"
KEYS = sorted(REPORTS)
ROUND6 = ["q2c_district_burden_latest", "q5b_low_service_provinces", "q5c_triple_deprivation", "w4_top3_per_province", "v5_aid_gap", "s1_top_provinces"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_no_udf_no_decimal(spark, key):
    df = E.queries()[key](spark, SF)
    plan = _plan(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, (key, bad)
    for f in df.schema.fields:
        assert not f.dataType.simpleString().startswith("decimal"), (key, f)


@pytest.mark.parametrize("key", ROUND6)
def test_latest_round_reports_prune_partitions(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert "PartitionFilters: [isnotnull(round_id" in plan and "(round_id#" in plan and "= 6)" in plan, plan


def test_did_estimator_scans_fact_once(spark):
    plan = _plan(E.queries()["did_estimator"](spark, SF))
    assert plan.count("FileScan parquet") == 1


def test_flag_shares_single_scan(spark):
    plan = _plan(E.queries()["d3_aid_type_shares"](spark, SF))
    assert plan.count("FileScan parquet") == 1


def test_fact_scan_prunes_columns(spark):
    plan = _plan(E.queries()["q1a_idp_by_round"](spark, SF))
    read = [line for line in plan.splitlines() if "ReadSchema" in line and "idp_arrivals" in line][0]
    assert "host_population" not in read and "conflict_res_1" not in read


@pytest.mark.parametrize("key", ["l2_surges", "c1x_deteriorated", "s4_surge_r4_r5", "q1c_persistent_high", "w1_panel_longitudinal"])
def test_per_settlement_work_needs_no_shuffle(spark, key):
    # Fact and settlements are bucketed on settlement_id in the materialised panel.
    plan = _plan(E.queries()[key](spark, SF))
    assert "Bucketed: true" in plan
    # No shuffle keyed on settlement_id alone (the fact is never re-partitioned by it).
    assert not re.search(r"Exchange hashpartitioning\(settlement_id#\d+L?, \d+\)", plan), plan


def test_w1_windows_run_on_the_whole_panel(spark):
    plan = _plan(E.queries()["w1_panel_longitudinal"](spark, SF))
    assert plan.index("TakeOrderedAndProject(limit=60") < plan.index("Window [lag")  # the limit is above the windows
