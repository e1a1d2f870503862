"""The no-broadcast branches: with every row limit at zero and Spark's automatic broadcast
off, each report runs on bucketed tables with shuffle / sort-merge joins only, and must
still match its oracle. Bounded-result broadcasts (LIMIT k, one row) remain."""

import duckdb
import pytest

import fixtures
from helpers import assert_same
from panelscope.operators import geo
from panelscope.plans import views
from panelscope.plans.oracle import REPORT_SQL
from panelscope.plans.reports import REPORTS
from panelscope.sources import load_catalog, load_tables, write_tables
from panelscope.sources.tables import Tables

KEYS = sorted(REPORTS)
ORIGINAL_SMALL = Tables.small


@pytest.fixture(scope="module")
def big_mode(spark, tmp_path_factory):
    mp = pytest.MonkeyPatch()
    mp.setattr(geo, "GEO_BROADCAST_MAX_ROWS", -1)
    mp.setattr(geo, "LABEL_BROADCAST_MAX_ROWS", -1)
    mp.setattr(views, "LABEL_BROADCAST_MAX_ROWS", -1)
    mp.setattr(Tables, "small", lambda self, name, limit=None: self[name])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    src = fixtures.build(spark, str(tmp_path_factory.mktemp("src")))
    out = str(tmp_path_factory.mktemp("bucketed"))
    write_tables(load_tables(spark, src), out, buckets=4, database="panelscope_scale_test")
    con = duckdb.connect()
    fixtures.duck(con, src)
    yield load_catalog(spark, "panelscope_scale_test"), con
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    mp.undo()


@pytest.mark.parametrize("key", KEYS)
def test_report_without_broadcasts(big_mode, key):
    t, con = big_mode
    df = REPORTS[key](t)
    assert_same(df, con.sql(REPORT_SQL[key]))


@pytest.fixture()
def large_settlements(spark, big_mode):
    """Realistic large mode: settlements too big to broadcast, bounded dimensions still
    broadcast (Tables.small unpatched)."""
    mp = pytest.MonkeyPatch()
    mp.setattr(geo, "GEO_BROADCAST_MAX_ROWS", -1)
    mp.setattr(geo, "LABEL_BROADCAST_MAX_ROWS", -1)
    mp.setattr(views, "LABEL_BROADCAST_MAX_ROWS", -1)
    mp.setattr(Tables, "small", ORIGINAL_SMALL)
    yield load_catalog(spark, "panelscope_scale_test"), big_mode[1]
    mp.undo()


@pytest.mark.parametrize("key", ["q4b_aid_by_province", "l2_surges", "v2_observations_full", "w4_top3_per_province"])
def test_fact_geo_join_is_bucketed_merge_join(large_settlements, key):
    # The fact x geo join is a sort-merge join of the two bucketed tables, with no
    # exchange on settlement_id on either side.
    t, con = large_settlements
    df = REPORTS[key](t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [settlement_id" in plan, plan
    assert "Exchange hashpartitioning(settlement_id" not in plan, plan
    assert_same(df, con.sql(REPORT_SQL[key]))


def test_full_panel_is_not_broadcast(large_settlements):
    # Its rows are as many as the panel's; the 60 rows of the shortened report may be broadcast.
    t, con = large_settlements
    broadcast_rows = "leftHint=(strategy=broadcast)"
    shown = {k: REPORTS[k](t)._jdf.queryExecution().optimizedPlan().toString() for k in ("w1_panel_full", "w1_panel_longitudinal")}
    assert broadcast_rows not in shown["w1_panel_full"], shown["w1_panel_full"]
    assert broadcast_rows in shown["w1_panel_longitudinal"]
    assert_same(REPORTS["w1_panel_full"](t), con.sql(REPORT_SQL["w1_panel_full"]))


def test_hot_group_of_copies_disables_bucketing(spark, tmp_path):
    # One (settlement, round) copied 300 times: about a third of the fact.
    obs = fixtures._observations()
    hot = list(obs[0])
    copies = []
    for i in range(300):
        row = list(hot)
        row[0] = 10**9 + i
        copies.append(tuple(row))
    src = fixtures.build(spark, str(tmp_path / "src"), observations=obs + copies)
    out = str(tmp_path / "store")
    write_tables(load_tables(spark, src), out, buckets=4, database="panelscope_hot_test")
    t = load_catalog(spark, "panelscope_hot_test")
    assert t.observations.count() == len(obs) + 300  # nothing dropped
    con = duckdb.connect()
    fixtures.duck(con, src)
    for key in ("q1a_idp_by_round", "v4_national_dashboard", "q4b_aid_by_province", "s3_districts_always_aided", "dq_unique_keys"):
        df = REPORTS[key](t)
        assert "Bucketed: true" not in df._jdf.queryExecution().executedPlan().toString()
        assert_same(df, con.sql(REPORT_SQL[key]))


def test_hot_group_of_copies_uses_segmented_scans(spark, tmp_path):
    import re

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    obs = fixtures._observations()
    copies = []
    for i in range(300):
        row = list(obs[0])
        row[0] = 10**9 + i
        copies.append(tuple(row))
    src = fixtures.build(spark, str(tmp_path / "src"), observations=obs + copies)
    write_tables(load_tables(spark, src), str(tmp_path / "store"), buckets=4, database="panelscope_hot_scan")
    t = load_catalog(spark, "panelscope_hot_scan")
    assert t.unit_key_bounded is False
    con = duckdb.connect()
    fixtures.duck(con, src)
    assert_same(REPORTS["w1_panel_longitudinal"](t), con.sql(REPORT_SQL["w1_panel_longitudinal"]))
    assert_same(REPORTS["w1_panel_full"](t), con.sql(REPORT_SQL["w1_panel_full"]))
    assert_same(REPORTS["d2_median_by_province_round"](t), con.sql(REPORT_SQL["d2_median_by_province_round"]))
    for key in ("l2_surges", "lead_next_round", "w2_moving_avg_settlement"):
        df = REPORTS[key](t)
        if key != "l2_surges":
            assert_same(df, con.sql(REPORT_SQL[key]))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "_seg" in plan
        # Windows partitioned by settlement_id alone only run over the per-segment table.
        for line in plan.splitlines():
            if re.search(r"Window \[[^\n]*\], \[settlement_id#\d+L?\], ", line):
                assert any(c in line for c in ("_tot", "_last", "_first", "_size")), line
        assert df.count() > 0
    # l2 equals the plain window with the same tie-break (brute force on the same tables).
    w = Window.partitionBy("settlement_id").orderBy("round_id", "observation_id")
    lag = t.observations.withColumn("prev", F.lag("idp_arrivals").over(w))
    want = lag.where((F.col("prev") > 0) & (F.col("idp_arrivals") > F.col("prev") * 1.5)).select(
        "observation_id", "prev"
    )
    from panelscope.operators.panel import surges

    got = surges(t.observations, "settlement_id", "round_id", "idp_arrivals", 1.5, tiebreak="observation_id", segmented=True)
    assert sorted(map(tuple, got.select("observation_id", "prev").collect())) == sorted(map(tuple, want.collect()))


def test_a_surplus_row_keeps_the_layout(spark, tmp_path):
    obs = fixtures._observations()
    surplus = list(obs[0])
    surplus[0] = 10**9
    src = fixtures.build(spark, str(tmp_path / "src"), observations=[*obs, tuple(surplus)])
    write_tables(load_tables(spark, src), str(tmp_path / "store"), buckets=4, database="panelscope_surplus")
    t = load_catalog(spark, "panelscope_surplus")
    assert t.unit_key_bounded is True
    con = duckdb.connect()
    fixtures.duck(con, src)
    assert_same(REPORTS["l2_surges"](t), con.sql(REPORT_SQL["l2_surges"]))


def test_top_trajectories_broadcast_only_the_top_units(spark, tmp_path):
    src = fixtures.build(spark, str(tmp_path / "src"))
    plan = REPORTS["l1_top_trajectories"](load_tables(spark, src))._jdf.queryExecution().executedPlan().toString()
    limit, fact = plan.index("TakeOrderedAndProject(limit=10"), plan.index("BroadcastExchange")
    assert fact < limit  # the limited frame is below the broadcast that meets the fact


def test_two_distinct_counts_do_not_expand_the_rows(spark, tmp_path):
    src = fixtures.build(spark, str(tmp_path / "src"))
    t = load_tables(spark, src)
    for key in ("s3_districts_always_aided", "b1_coverage_province"):
        assert "Expand" not in REPORTS[key](t)._jdf.queryExecution().executedPlan().toString()
