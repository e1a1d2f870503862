
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import TESTDATA
from panelscope.sources.binding import tables_for

SF = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_shares_sum_to_100(spark, q):
    shares = [r.share_of_national_total_pct for r in q["q2a_province_burden"](spark, SF).collect()]
    assert abs(sum(shares) - 100.0) <= 0.005 * len(shares) + 1e-9
    pcts = [r.pct for r in q["d1_security_distribution"](spark, SF).collect()]
    assert abs(sum(pcts) - 100.0) <= 0.005 * len(pcts) + 1e-9


def test_running_total_at_last_round_is_the_sum(spark):
    from pyspark.sql import Window

    t = tables_for(spark, SF)
    from panelscope.operators.panel import running_total

    rt = running_total(t.observations, "settlement_id", "round_id", "idp_arrivals", "cum")
    last = rt.withColumn("_mx", F.max("round_id").over(Window.partitionBy("settlement_id"))).where(F.col("round_id") == F.col("_mx"))
    sums = t.observations.groupBy("settlement_id").agg(F.sum("idp_arrivals").alias("s"))
    bad = last.join(sums, "settlement_id").where(~F.col("cum").eqNullSafe(F.col("s"))).count()
    assert bad == 0


def test_did_is_difference_of_changes(spark, q):
    r = q["did_estimator"](spark, SF).first()
    assert abs(r.did_estimator_idp_arrivals - (r.treatment_group_change - r.control_group_change)) <= 0.01
    rows = {x.group_label: x.mean_idp for x in q["s6_did_report"](spark, SF).collect()}
    did = (rows["Treatment — Post"] - rows["Treatment — Pre"]) - (rows["Control — Post"] - rows["Control — Pre"])
    assert abs(rows["──── DiD Estimator ────"] - did) <= 1e-4


def test_single_pass_did_equals_per_cell_means(spark, q):
    t = tables_for(spark, SF)
    cells = {
        (r.post_intervention, r.diff_in_diff): r.m
        for r in t.observations.groupBy("post_intervention", "diff_in_diff").agg(F.avg("idp_arrivals").alias("m")).collect()
    }
    naive = (cells[(1, 1)] - cells[(0, 1)]) - (cells[(1, 0)] - cells[(0, 0)])
    assert abs(q["did_estimator"](spark, SF).first().did_estimator_idp_arrivals - naive) <= 5e-5  # 4 dp rounding


def test_pivot_rows_sum_to_grand_total(spark, q):
    cols = ["round10_Jun2020", "round11_Dec2020", "round12_Mar2021", "round13_Jun2021", "round14_Dec2021", "round16_2022"]
    for r in q["q2b_province_pivot"](spark, SF).collect():
        assert sum(getattr(r, c) or 0 for c in cols) == r.grand_total


def test_top_n_per_group_bounded(spark, q):
    per = q["w4_top3_per_province"](spark, SF).groupBy("province_name").agg(F.count(F.lit(1)).alias("n"), F.max("province_rank").alias("mx"))
    assert all(r.n <= 3 and r.mx <= 3 for r in per.collect())


def test_view_totals_agree(spark, q):
    # Province x round summary adds up to the national dashboard for fully-joined rows.
    v3 = q["v3_province_summary"](spark, SF).groupBy("round_id").agg(F.sum("total_idp_arrivals").alias("s"))
    v4 = q["v4_national_dashboard"](spark, SF).select("round_id", "total_idp_arrivals")
    assert v3.join(v4, "round_id").where(F.col("s") != F.col("total_idp_arrivals")).count() == 0
