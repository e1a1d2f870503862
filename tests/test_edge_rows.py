"""Reports on hand-made tables with edge cases, against the SQL oracle on the same files,
plus direct assertions on the cases themselves."""

import duckdb
import pytest
from pyspark.sql import functions as F

import fixtures
from helpers import assert_same, assert_same_order
from panelscope.operators.panel import surges
from panelscope.plans.oracle import REPORT_SQL
from panelscope.plans.reports import REPORTS
from panelscope.sources import load_tables
from panelscope.sources.schema import OBSERVATIONS

KEYS = sorted(REPORTS)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    path = fixtures.build(spark, str(tmp_path_factory.mktemp("edge")))
    con = duckdb.connect()
    fixtures.duck(con, path)
    return load_tables(spark, path), con


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = fixtures.build(spark, str(tmp_path_factory.mktemp("empty")), observations=[])
    con = duckdb.connect()
    fixtures.duck(con, path)
    return load_tables(spark, path), con


@pytest.mark.parametrize("key", KEYS)
def test_edge_matches_oracle(edge, key):
    t, con = edge
    assert_same(REPORTS[key](t), con.sql(REPORT_SQL[key]))


UNSORTED = {
    *("w2_moving_avg_settlement", "w3_settlement_percentiles", "s9_incremental_load", "s2_checked_load", "s6_clustered_lookup", "p15_box_lookup"),
    *("v3_stored", "q2a_stored"),
    *("s9_flat_roundtrip", "a1_row_counts", "s6_did_report", "lead_next_round", "v1_settlement_full", "v2_observations_full", "v3_province_summary"),
}


@pytest.mark.parametrize("key", [k for k in KEYS if k not in UNSORTED and not k.startswith("dq_")])
def test_rows_come_in_the_reports_order(edge, key):
    t, con = edge
    assert_same_order(REPORTS[key](t), con.sql(REPORT_SQL[key]))


@pytest.mark.parametrize("key", KEYS)
def test_empty_fact_matches_oracle(empty, key):
    t, con = empty
    assert_same(REPORTS[key](t), con.sql(REPORT_SQL[key]))


def test_surges_strict_and_zero_previous(edge):
    t, _ = edge
    found = {
        (r.settlement_id, r.round_id): r.prev
        for r in surges(t.observations, "settlement_id", "round_id", "idp_arrivals", 1.5).collect()
    }
    assert (103, 2) not in found  # previous 0 is excluded
    assert (104, 2) not in found  # exactly +50 % is not a surge
    assert found[(104, 3)] == 150


def test_unbalanced_panel_lag_and_audit(edge):
    t, _ = edge
    out = REPORTS["dq_unbalanced_units"](t).collect()
    assert [(r.settlement_id, r.periods_observed, r.periods_expected) for r in out] == [(108, 5, 6)]
    w1 = REPORTS["w1_panel_longitudinal"](t).where(F.col("settlement_name") == "S108").collect()
    r4 = [r for r in w1 if r.round_label == "Round 13"][0]
    r2 = [r for r in w1 if r.round_label == "Round 11"][0]
    assert r4.prev_round_arrivals == r2.idp_arrivals  # LAG steps over the missing round


def test_priority_score_integer_division_and_null(edge):
    t, _ = edge
    rows = {r.settlement_name: r for r in REPORTS["v5_aid_gap"](t).collect()}
    r = rows["S106"]
    expect = 750 // 100 + r.idp_conflict_severity * 50 + r.idp_disaster_severity * 30 + (5 - 2) * 10
    expect += (1 - r.health_clinics_available) * 20 + (1 - r.schools_available) * 10
    assert r.priority_score == expect


def test_orphans_are_dropped_and_audited(edge):
    t, _ = edge
    fk = {(r.child_table, r.child_column): r.orphan_rows for r in REPORTS["dq_foreign_keys"](t).collect()}
    assert fk[("observations", "settlement_id")] == 6  # settlement 999
    assert fk[("settlements", "adm2_code")] == 1  # P9999
    assert fk[("districts", "province_id")] == 1  # province 99
    names = {r.settlement_name for r in REPORTS["v2_observations_full"](t).select("settlement_name").distinct().collect()}
    assert not names & {"S901", "S902"}


def test_ties_rank_gaps(edge):
    t, _ = edge
    top = REPORTS["w4_top3_per_province"](t).where(F.col("province_name") == "Alpha").orderBy("province_rank").collect()
    assert [r.province_rank for r in top] == [1, 2, 3]
    assert top[0].idp_arrivals >= top[1].idp_arrivals >= top[2].idp_arrivals


def test_missing_did_cell_drops_province(edge):
    t, _ = edge
    provinces = {r.province_name for r in REPORTS["did_by_province"](t).collect()}
    assert "Gamma" not in provinces and {"Alpha", "Beta"} <= provinces


def test_null_latitude_not_north(edge):
    t, _ = edge
    rows = REPORTS["s8_north_filter"](t).collect()
    assert rows and all(r.latitude is not None and r.latitude > 36.0 for r in rows)


def test_coverage_tiers_at_exact_cuts(spark, tmp_path):
    # One settlement per province with 10 (or 100) rows whose aid averages hit the cuts.
    provinces = [(i, f"P{i}", f"P{i:02d}") for i in range(1, 6)]
    districts = [(i, f"P{i:02d}01", f"D{i}", i) for i in range(1, 6)]
    settlements = [(i, f"C{i}", f"S{i}", f"P{i:02d}01", None, None, None, None) for i in range(1, 6)]
    plan = {1: (7, 10), 2: (4, 10), 3: (2, 10), 4: (19, 100), 5: (None, 10)}
    cols = OBSERVATIONS.fieldNames()
    obs, oid = [], 0
    for sid, (ones, n) in plan.items():
        for j in range(n):
            oid += 1
            row = dict.fromkeys(cols)
            row.update(observation_id=oid, settlement_id=sid, round_id=j % 6 + 1)
            row["humanitarian_aid_delivered"] = None if ones is None else int(j < ones)
            obs.append(tuple(row[c] for c in cols))
    path = fixtures.build(
        spark, str(tmp_path), observations=obs, provinces=provinces, districts=districts, settlements=settlements
    )
    t = load_tables(spark, path)
    got = {r.province_name: (r.aid_coverage_pct, r.coverage_tier) for r in REPORTS["s2_aid_tiers"](t).collect()}
    assert got == {
        "P1": (70.0, "High Coverage"),
        "P2": (40.0, "Moderate Coverage"),
        "P3": (20.0, "Low Coverage"),
        "P4": (19.0, "Critical Gap"),
        "P5": (None, "Critical Gap"),
    }
    con = duckdb.connect()
    fixtures.duck(con, path)
    for key in ("s2_aid_tiers", "c2x_vulnerability_index", "did_estimator", "s6_did_report", "d2_idp_summary"):
        assert_same(REPORTS[key](t), con.sql(REPORT_SQL[key]))
    # All security values NULL -> every province average NULL -> index NULL, no error.
    assert all(r.vulnerability_index is None for r in REPORTS["c2x_vulnerability_index"](t).collect())


def test_audits_count_violations(spark, edge):
    """The edge tables break every kind of constraint; the audits' counts are not all zero."""
    t, _ = edge
    orphans = {(r.child_table, r.child_column): r.orphan_rows for r in REPORTS["dq_foreign_keys"](t).collect()}
    assert orphans[("observations", "settlement_id")] > 0 and orphans[("settlements", "adm2_code")] > 0
    assert orphans[("districts", "province_id")] > 0
    twice = t.with_observations(t.observations.union(t.observations.where("round_id = 2")).withColumn("security_situation", F.lit(9)))
    keys = {r.key_columns: (r.duplicate_keys, r.duplicate_rows) for r in REPORTS["dq_unique_keys"](twice).where("table_name = 'observations'").collect()}
    n = t.observations.where("round_id = 2").count()
    assert keys["observation_id"] == (n, 2 * n)
    levels = {r.column_name: r.out_of_range for r in REPORTS["dq_value_domains"](twice).collect()}
    assert levels["security_situation"] == twice.observations.count() and levels["aid_cash"] == 0
    assert REPORTS["dq_unbalanced_units"](t).count() > 0


def test_rounds_delivered_twice_count_settlements_once(edge):
    t, _ = edge
    want = {r.round_id: r.settlements_surveyed for r in REPORTS["v4_national_dashboard"](t).collect()}
    twice = t.with_observations(t.observations.union(t.observations))
    assert {r.round_id: r.settlements_surveyed for r in REPORTS["v4_national_dashboard"](twice).collect()} == want
