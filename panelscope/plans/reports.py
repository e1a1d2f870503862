"""Every report of the catalogue as a function ``Tables -> DataFrame``.

Conventions shared by all reports:
* Facts are joined to the hierarchy *keys* only (``with_geo``), aggregated by id, and
  names are attached to the aggregated or LIMITed result.
* Filters on round_id and flags are applied to the fact before any join, so they reach
  the Parquet scan (partition pruning on round_id, pushed filters on the rest).
* Rows come back in the report's order: the last step, after the labels, sorts by the
  report's keys followed by a unique tie-break (an id). LIMITed reports cut by the same
  order before the labels are attached, so the rows kept at the cut are deterministic. The
  views stay unsorted; their report keys sort.
* Output names and types are fixed: counts and sums BIGINT, rounded values DOUBLE, ranks
  BIGINT, labels STRING.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.expr import (
    SECURITY_LABELS,
    count_where,
    label_levels,
    mean_r,
    pct,
    pct_of,
    round_half_up,
    safe_div,
    tier,
    yes_no,
)
from panelscope.operators import audit
from panelscope.operators.aggregate import kpis_by, persistent, pivot_periods, share_of_total, total_over
from panelscope.operators.causal import CELLS, control_change, did_cells, did_estimate, treated_change
from panelscope.operators.geo import (
    attach_labels,
    district_labels,
    geo_filter,
    province_labels,
    settlement_full,
    with_geo,
    with_rounds,
)
from panelscope.operators.panel import (
    moving_avg,
    period_compare,
    period_delta,
    running_total,
    surges,
    top_units,
    unit_scan,
)
from panelscope.operators.rank import (
    composite_rank,
    global_rank,
    ntile_from,
    ntile_of,
    pct_rank_of,
    percent_rank_from,
    positions,
    rank_in,
    rank_rows,
    top_n_per,
)
from panelscope.operators.score import composite_index
from panelscope.operators.space import Box, box_filter
from panelscope.operators.stats import kth_in
from panelscope.plans import views
from panelscope.plans.store import ViewStore
from panelscope.sources.checked import load_checked
from panelscope.sources.clustering import write_clustered, write_gridded
from panelscope.sources.flat import normalize_flat
from panelscope.sources.flat_store import FlatStore
from panelscope.sources.schema import TABLE_NAMES
from panelscope.sources.tables import Tables, load_tables, scratch_path

# Report labels.
ROUND_CONTEXT = {
    1: "Baseline (COVID-19 onset)",
    2: "Post-COVID first wave",
    3: "Pre-Taliban transition",
    4: "Late Republic",
    5: "Post-Taliban takeover",
    6: "Consolidation period",
}
# (post, treatment) -> label; the padded form is used by the group tables, the other by
# the DiD summary report.
DID_LABELS_PADDED = {
    (0, 0): "Control   — Pre",
    (1, 0): "Control   — Post",
    (0, 1): "Treatment — Pre",
    (1, 1): "Treatment — Post",
}
DID_LABELS = {
    (0, 0): "Control — Pre",
    (1, 0): "Control — Post",
    (0, 1): "Treatment — Pre",
    (1, 1): "Treatment — Post",
}
DID_ESTIMATOR_LABEL = "──── DiD Estimator ────"
PIVOT_COLUMNS = {
    1: "round10_Jun2020",
    2: "round11_Dec2020",
    3: "round12_Mar2021",
    4: "round13_Jun2021",
    5: "round14_Dec2021",
    6: "round16_2022",
}
AID_TYPES = {
    "Emergency Shelter": "aid_emergency_shelter",
    "Food Distribution": "aid_food_distribution",
    "Cash Assistance": "aid_cash",
    "Infrastructure": "aid_infrastructure",
}
COVERAGE_TIERS = [(0.7, "High Coverage"), (0.4, "Moderate Coverage"), (0.2, "Low Coverage")]
COVERAGE_ELSE = "Critical Gap"
TREND_DECLINED, TREND_IMPROVED, TREND_STABLE = "⚠ Declined", "✓ Improved", "— Stable"
DID_REDUCED = "Intervention reduced displacement"
DID_INCREASED = "Displacement increased despite intervention"
DID_NONE = "No effect"

LATEST_ROUND = 6
N_ROUNDS = 6


def _did_label(labels: dict[tuple[int, int], str]):
    out = None
    for (p, t), name in labels.items():
        cond = (F.col("post_intervention") == p) & (F.col("diff_in_diff") == t)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def _obs(t: Tables) -> DataFrame:
    return t.observations


def _down(col: str):
    return F.col(col).desc_nulls_last()


def _up(col: str):
    return F.col(col).asc_nulls_first()


# ── exploration and data quality ─────────────────────────────────────────────────────


def a1_row_counts(t: Tables) -> DataFrame:
    return audit.row_counts({n: t[n] for n in ("provinces", "districts", "settlements", "survey_rounds", "observations")})


def a2_rounds_context(t: Tables) -> DataFrame:
    return t.survey_rounds.select(
        "round_id", "round_label", "round_period", label_levels("round_id", ROUND_CONTEXT).alias("context_note")
    ).orderBy("round_id")


def a3_panel_balance(t: Tables) -> DataFrame:
    agg = kpis_by(
        _obs(t),
        ["round_id"],
        F.count("observation_id").alias("num_observations"),
        F.countDistinct("settlement_id").alias("num_settlements"),
    )
    return with_rounds(agg, t, "round_label", "round_period").orderBy("round_id").select(
        "round_label", "round_period", "num_observations", "num_settlements"
    )


def _settlement_geo(t: Tables) -> DataFrame:
    """settlements x districts x provinces keys (dimension chain without the fact)."""
    return t.hierarchy()


def b1_coverage_province(t: Tables) -> DataFrame:
    # A settlement has one district: districts first, then provinces, with one distinct count.
    by_district = _settlement_geo(t).groupBy("province_id", "district_id").agg(F.countDistinct("settlement_id").alias("n"))
    agg = by_district.groupBy("province_id").agg(F.count("district_id").alias("num_districts"), F.sum("n").alias("num_settlements"))
    named = agg.join(province_labels(t, "province_name", "adm1_code"), "province_id")
    return named.orderBy(_down("num_settlements"), "province_id").select("province_name", "adm1_code", "num_districts", "num_settlements")


def b2_top_districts(t: Tables, k: int = 10) -> DataFrame:
    agg = _settlement_geo(t).groupBy("district_id").agg(F.countDistinct("settlement_id").alias("settlements"))
    top = agg.orderBy(F.col("settlements").desc(), F.col("district_id")).limit(k)
    named = top.join(district_labels(t), "district_id").orderBy(_down("settlements"), "district_id")
    return named.select("province_name", "district_name", "settlements")


def c1_null_audit(t: Tables) -> DataFrame:
    return audit.null_audit(
        _obs(t),
        {
            "null_host_pop": "host_population",
            "null_idp_arrivals": "idp_arrivals",
            "null_change_idp": "change_idp_arrivals",
            "null_conflict_sev": "idp_conflict_severity",
            "null_disaster_sev": "idp_disaster_severity",
            "null_security": "security_situation",
            "null_health": "health_clinics_available",
            "null_schools": "schools_available",
        },
    )


def c2_null_by_round(t: Tables) -> DataFrame:
    agg = audit.null_audit_by(_obs(t), "change_idp_arrivals", ["round_id"])
    return with_rounds(agg, t, "round_label").orderBy("round_id").select("round_label", "total", "null_change", "pct_null")


def d1_security_distribution(t: Tables) -> DataFrame:
    levels = audit.distribution(_obs(t), "security_situation", SECURITY_LABELS, 2)
    return levels.withColumnRenamed("level", "security_level").orderBy(_up("security_level"))


def d2_idp_summary(t: Tables) -> DataFrame:
    return audit.numeric_summary(_obs(t), "idp_arrivals", where=F.col("idp_arrivals") > 0, median_over_all=True)


def d3_aid_type_shares(t: Tables) -> DataFrame:
    return audit.flag_shares(_obs(t), AID_TYPES, 2).orderBy(_down("pct_delivered"), "aid_type")


def d4_did_group_sizes(t: Tables) -> DataFrame:
    agg = did_cells(_obs(t), "post_intervention", "diff_in_diff", F.count(F.lit(1)).alias("obs_count"))
    return agg.select(
        F.col("post_intervention").alias("post"),
        F.col("diff_in_diff").alias("treatment"),
        _did_label(DID_LABELS_PADDED).alias("group_label"),
        "obs_count",
    ).orderBy(_up("post"), _up("treatment"))


# ── core analysis ────────────────────────────────────────────────────────────────────


def q1a_idp_by_round(t: Tables) -> DataFrame:
    agg = kpis_by(
        _obs(t),
        ["round_id"],
        F.sum("idp_arrivals").cast("long").alias("total_idp_arrivals"),
        mean_r("idp_arrivals", 1).alias("avg_per_settlement"),
        F.max("idp_arrivals").alias("max_single_settlement"),
        F.count(F.when(F.col("idp_arrivals") > 0, F.lit(1))).alias("settlements_with_idps"),
    )
    return with_rounds(agg, t, "round_label", "round_period").orderBy("round_id").select(
        "round_id",
        "round_label",
        "round_period",
        "total_idp_arrivals",
        "avg_per_settlement",
        "max_single_settlement",
        "settlements_with_idps",
    )


def q1b_round_change(t: Tables) -> DataFrame:
    totals = with_rounds(
        kpis_by(_obs(t), ["round_id"], F.sum("idp_arrivals").cast("long").alias("total_idps")), t, "round_label"
    )
    # Global window over one row per round.
    out = period_delta(totals, "total_idps", "round_id", prev="prev_round_total", delta="abs_change", pct="pct_change")
    return out.select("round_id", "round_label", "total_idps", "prev_round_total", "abs_change", "pct_change").orderBy("round_id")


def q1c_persistent_high(t: Tables, threshold: int = 1000, n_rounds: int = N_ROUNDS, k: int = 20) -> DataFrame:
    agg = persistent(
        with_geo(_obs(t), t),
        ["settlement_id", "district_id", "province_id"],
        "round_id",
        F.col("idp_arrivals") > threshold,
        n_rounds,
        F.min("idp_arrivals").alias("min_arrivals"),
        F.max("idp_arrivals").alias("max_arrivals"),
        mean_r("idp_arrivals", 0).alias("avg_arrivals"),
        periods="rounds_above_threshold",
    )
    top = agg.orderBy(F.col("avg_arrivals").desc_nulls_last(), F.col("settlement_id")).limit(k)
    out = attach_labels(top, t, ("settlement_code", "settlement_name"), district=True, province=True)
    return out.orderBy(_down("avg_arrivals"), "settlement_id").select(
        "settlement_code",
        "settlement_name",
        "province_name",
        "district_name",
        "rounds_above_threshold",
        "min_arrivals",
        "max_arrivals",
        "avg_arrivals",
    )


def q1c_persistent_high_t500(t: Tables) -> DataFrame:
    """q1c at threshold 500, where the LIMIT 20 cut is reached on the test tables."""
    return q1c_persistent_high(t, threshold=500)


def q2a_province_burden(t: Tables) -> DataFrame:
    # One scan: a LEFT join to the geo keys keeps observations without a full hierarchy in
    # a NULL-province group, so the national total (the denominator, over ALL
    # observations) is the sum over the aggregated groups; the NULL group is dropped after.
    agg = with_geo(_obs(t), t, how="left").groupBy("province_id").agg(
        F.countDistinct("settlement_id").alias("settlements_assessed"),
        F.sum("idp_arrivals").cast("long").alias("total_idp_arrivals"),
        mean_r("idp_arrivals", 1).alias("avg_per_settlement"),
    )
    agg = agg.withColumn("_national", total_over("total_idp_arrivals")).where(F.col("province_id").isNotNull())
    return agg.join(province_labels(t), "province_id").orderBy(_down("total_idp_arrivals"), "province_id").select(
        "province_name",
        "settlements_assessed",
        "total_idp_arrivals",
        "avg_per_settlement",
        share_of_total(F.col("total_idp_arrivals"), F.col("_national"), 2).alias("share_of_national_total_pct"),
    )


def q2b_province_pivot(t: Tables, k: int = 15) -> DataFrame:
    piv = pivot_periods(with_geo(_obs(t), t), ["province_id"], "round_id", "idp_arrivals", PIVOT_COLUMNS, "grand_total")
    top = piv.orderBy(F.col("grand_total").desc_nulls_last(), F.col("province_id")).limit(k)
    named = top.join(province_labels(t), "province_id").orderBy(_down("grand_total"), "province_id")
    return named.select("province_name", *PIVOT_COLUMNS.values(), "grand_total")


def q2c_district_burden_latest(t: Tables, round_id: int = LATEST_ROUND, k: int = 15) -> DataFrame:
    o = with_geo(_obs(t).where(F.col("round_id") == round_id), t)
    agg = o.groupBy("district_id").agg(
        F.countDistinct("settlement_id").alias("settlements"),
        F.sum("idp_arrivals").cast("long").alias("total_idps_round6"),
        mean_r("security_situation", 2).alias("avg_security_score"),
        mean_r("idp_conflict_severity", 2).alias("avg_conflict_severity"),
    )
    top = agg.orderBy(F.col("total_idps_round6").desc_nulls_last(), F.col("district_id")).limit(k)
    return top.join(district_labels(t), "district_id").orderBy(_down("total_idps_round6"), "district_id").select(
        "province_name", "district_name", "settlements", "total_idps_round6", "avg_security_score", "avg_conflict_severity"
    )


def q3a_security_by_round(t: Tables) -> DataFrame:
    high = count_where(F.col("security_situation") >= 4)
    agg = kpis_by(
        _obs(t),
        ["round_id"],
        mean_r("security_situation", 3).alias("avg_security_score"),
        high.alias("high_threat_settlements"),
        pct_of(high, F.count(F.lit(1)), 1).alias("pct_high_threat"),
    )
    return with_rounds(agg, t, "round_label", "round_period").orderBy("round_id").select(
        "round_label", "round_period", "avg_security_score", "high_threat_settlements", "pct_high_threat"
    )


def q3b_insecure_provinces(t: Tables, k: int = 10) -> DataFrame:
    extreme = count_where(F.col("security_situation") == 5)
    agg = with_geo(_obs(t), t).groupBy("province_id").agg(
        mean_r("security_situation", 3).alias("avg_security"),
        extreme.alias("extreme_threat_obs"),
        pct_of(extreme, F.count(F.lit(1)), 1).alias("pct_extreme"),
    )
    top = agg.orderBy(F.col("avg_security").desc_nulls_last(), F.col("province_id")).limit(k)
    named = top.join(province_labels(t), "province_id").orderBy(_down("avg_security"), "province_id")
    return named.select("province_name", "avg_security", "extreme_threat_obs", "pct_extreme")


def q3c_security_vs_idp(t: Tables) -> DataFrame:
    agg = _obs(t).groupBy(F.col("security_situation").alias("security_level")).agg(
        F.count(F.lit(1)).alias("observations"),
        mean_r("idp_arrivals", 1).alias("avg_idp_arrivals"),
        mean_r("idp_conflict_severity", 2).alias("avg_conflict_severity"),
        mean_r("host_population", 0).alias("avg_host_population"),
    )
    return agg.select(
        "security_level",
        label_levels("security_level", SECURITY_LABELS).alias("label"),
        "observations",
        "avg_idp_arrivals",
        "avg_conflict_severity",
        "avg_host_population",
    ).orderBy(_up("security_level"))


def q4a_aid_by_round(t: Tables) -> DataFrame:
    agg = kpis_by(
        _obs(t),
        ["round_id"],
        F.count(F.lit(1)).alias("total_settlements"),
        F.sum("humanitarian_aid_delivered").cast("long").alias("settlements_received_aid"),
        pct("humanitarian_aid_delivered").alias("pct_coverage"),
        pct("aid_emergency_shelter").alias("pct_shelter"),
        pct("aid_food_distribution").alias("pct_food"),
        pct("aid_cash").alias("pct_cash"),
        pct("aid_infrastructure").alias("pct_infra"),
    )
    return with_rounds(agg, t, "round_label", "round_period").orderBy("round_id").select(
        "round_label",
        "round_period",
        "total_settlements",
        "settlements_received_aid",
        "pct_coverage",
        "pct_shelter",
        "pct_food",
        "pct_cash",
        "pct_infra",
    )


def q4b_aid_by_province(t: Tables) -> DataFrame:
    agg = with_geo(_obs(t), t).groupBy("province_id").agg(
        F.count(F.lit(1)).alias("total_obs"),
        pct("humanitarian_aid_delivered").alias("pct_aid_delivered"),
        pct("aid_food_distribution").alias("pct_food"),
        pct("aid_cash").alias("pct_cash"),
        pct("aid_emergency_shelter").alias("pct_shelter"),
        mean_r("idp_arrivals", 0).alias("avg_idp_arrivals"),
    )
    return agg.join(province_labels(t), "province_id").orderBy(_down("pct_aid_delivered"), "province_id").select(
        "province_name", "total_obs", "pct_aid_delivered", "pct_food", "pct_cash", "pct_shelter", "avg_idp_arrivals"
    )


def q4c_aid_gap_rows(t: Tables, min_arrivals: int = 1000, k: int = 25) -> DataFrame:
    o = _obs(t).where((F.col("humanitarian_aid_delivered") == 0) & (F.col("idp_arrivals") > min_arrivals))
    o = with_rounds(with_geo(o, t), t, "round_label")
    order = [_down("idp_arrivals"), F.col("settlement_id"), F.col("round_id"), F.col("observation_id")]
    top = o.orderBy(*order).limit(k)
    out = attach_labels(top, t, ("settlement_name",), district=True, province=True)
    return out.orderBy(*order).select(
        "province_name",
        "district_name",
        "settlement_name",
        "round_label",
        "idp_arrivals",
        "security_situation",
        "idp_conflict_severity",
        "idp_disaster_severity",
    )


def q5a_services_by_round(t: Tables) -> DataFrame:
    agg = kpis_by(
        _obs(t),
        ["round_id"],
        pct("health_clinics_available").alias("pct_health_access"),
        pct("schools_available").alias("pct_school_access"),
    ).withColumn("health_school_gap", F.col("pct_health_access") - F.col("pct_school_access"))
    return with_rounds(agg, t, "round_label", "round_period").orderBy("round_id").select(
        "round_label", "round_period", "pct_health_access", "pct_school_access", "health_school_gap"
    )


def q5b_low_service_provinces(t: Tables, round_id: int = LATEST_ROUND, k: int = 10) -> DataFrame:
    o = with_geo(_obs(t).where(F.col("round_id") == round_id), t)
    agg = o.groupBy("province_id").agg(
        pct("health_clinics_available").alias("pct_health"),
        pct("schools_available").alias("pct_schools"),
        pct("humanitarian_aid_delivered").alias("pct_aid"),
        F.count(F.lit(1)).alias("settlements"),
    )
    order = [(F.col("pct_health") + F.col("pct_schools")).asc_nulls_first(), F.col("province_id")]
    top = agg.orderBy(*order).limit(k).join(province_labels(t), "province_id")
    return top.orderBy(*order).select("province_name", "pct_health", "pct_schools", "pct_aid", "settlements")


def q5c_triple_deprivation(t: Tables, round_id: int = LATEST_ROUND) -> DataFrame:
    o = _obs(t).where(
        (F.col("round_id") == round_id)
        & (F.col("health_clinics_available") == 0)
        & (F.col("schools_available") == 0)
        & (F.col("humanitarian_aid_delivered") == 0)
    )
    agg = with_geo(o, t).groupBy("province_id").agg(
        F.count(F.lit(1)).alias("triply_deprived_settlements"),
        mean_r("idp_arrivals", 0).alias("avg_idp_arrivals"),
        mean_r("security_situation", 2).alias("avg_security"),
    )
    return agg.join(province_labels(t), "province_id").orderBy(_down("triply_deprived_settlements"), "province_id").select(
        "province_name", "triply_deprived_settlements", "avg_idp_arrivals", "avg_security"
    )


# ── advanced: windows, CTE chains, DiD, trajectories ────────────────────────────────


def _panel(t: Tables) -> DataFrame:
    """Every row of the panel that has a place and a round."""
    return with_geo(_obs(t), t).join(t.small("survey_rounds").select("round_id"), "round_id", "left_semi").select(
        "settlement_id", "round_id", "observation_id", "province_id", "idp_arrivals"
    )


def _panel_windows(t: Tables, base: DataFrame) -> DataFrame:
    """LAG and running SUM for every row of the panel."""
    if t.unit_key_bounded is False:  # a settlement may hold a third of all rows
        return unit_scan(
            base, "settlement_id", ["round_id", "observation_id"], "idp_arrivals", prev="prev_round_arrivals", cum="cumulative_idps"
        ).withColumn("round_change", F.col("idp_arrivals") - F.col("prev_round_arrivals"))
    run = period_delta(
        base, "idp_arrivals", "round_id", unit="settlement_id", prev="prev_round_arrivals", delta="round_change", tiebreak="observation_id"
    )
    return running_total(run, "settlement_id", "round_id", "idp_arrivals", "cumulative_idps", tiebreak="observation_id")


_PANEL_RANK = (["province_id", "round_id"], "idp_arrivals", "rank_in_province")
_PANEL_ORDER = ["settlement_id", "round_id", "observation_id"]


def _panel_shown(t: Tables, rows: DataFrame, bounded: bool) -> DataFrame:
    labels = ("settlement_code", "settlement_name")
    out = attach_labels(with_rounds(rows, t, "round_label"), t, labels, province=True, bounded=bounded)
    return out.orderBy(*_PANEL_ORDER).select(
        "settlement_code",
        "settlement_name",
        "province_name",
        "round_label",
        "idp_arrivals",
        "prev_round_arrivals",
        "round_change",
        F.col("cumulative_idps").cast("long").alias("cumulative_idps"),
        "rank_in_province",
    )


def w1_panel_longitudinal(t: Tables, k: int = 60) -> DataFrame:
    """The windows over the whole panel; the report shows its first ``k`` rows, whose ranks are read
    off the value counts of all rows of their provinces and rounds."""
    base = _panel(t)
    return _panel_shown(t, rank_rows(_panel_windows(t, base).orderBy(*_PANEL_ORDER).limit(k), base, *_PANEL_RANK), bounded=True)


def w1_panel_full(t: Tables) -> DataFrame:
    """The same for every row of the panel."""
    return _panel_shown(t, rank_in(_panel_windows(t, _panel(t)), *_PANEL_RANK), bounded=False)


def lead_next_round(t: Tables) -> DataFrame:
    """Each observation with its settlement's value in the next round."""
    rows = _obs(t).select("observation_id", "settlement_id", "round_id", "idp_arrivals")
    return period_delta(
        rows,
        "idp_arrivals",
        "round_id",
        unit="settlement_id",
        prev="next_round_arrivals",
        direction="lead",
        tiebreak="observation_id",
        segmented=t.unit_key_bounded is False,  # a settlement may hold a third of all rows
    )


def w2_moving_avg_settlement(t: Tables) -> DataFrame:
    """Each observation with the mean security level of its settlement's last three rows."""
    rows = _obs(t).select("observation_id", "settlement_id", "round_id", "security_situation")
    return moving_avg(
        rows,
        "settlement_id",
        "round_id",
        "security_situation",
        3,
        "moving_avg_3_rounds",
        digits=4,
        tiebreak="observation_id",
        segmented=t.unit_key_bounded is False,
    )


def w2_moving_avg_security(t: Tables) -> DataFrame:
    agg = with_geo(_obs(t), t).groupBy("province_id", "round_id").agg(mean_r("security_situation", 4).alias("avg_security"))
    named = agg.join(province_labels(t), "province_id")
    # Window groups: one province, at most one row per round.
    out = moving_avg(named, "province_name", "round_id", "avg_security", 3, "moving_avg_3_rounds", digits=4)
    return out.orderBy("province_name", "round_id", "province_id").select("province_name", "round_id", "avg_security", "moving_avg_3_rounds")


def w3_province_percentiles(t: Tables) -> DataFrame:
    totals = with_geo(_obs(t), t).groupBy("province_id").agg(
        F.sum("idp_arrivals").cast("long").alias("total_idps"), F.countDistinct("settlement_id").alias("settlements")
    )
    named = totals.join(province_labels(t), "province_id")
    # Global windows over one row per province.
    return named.select(
        "province_id",
        "province_name",
        "total_idps",
        "settlements",
        round_half_up(safe_div(F.col("total_idps"), F.col("settlements")), 1).alias("idp_per_settlement"),
        global_rank([F.col("total_idps").desc_nulls_last()]).alias("rank_by_total"),
        ntile_of(4, [F.col("total_idps").desc_nulls_last(), F.col("province_id")]).alias("quartile"),
        round_half_up(pct_rank_of([F.col("total_idps").asc_nulls_first()]) * F.lit(100.0), 1).alias("percentile"),
    ).orderBy(_down("total_idps"), "province_id").drop("province_id")


def w3_settlement_percentiles(t: Tables) -> DataFrame:
    """The ranks of w3 for settlements: as many rows as the panel has units, so the places come
    from a segmented order of them all instead of a window in one task."""
    totals = _obs(t).groupBy("settlement_id").agg(F.sum("idp_arrivals").cast("long").alias("total_idps"))
    return positions(totals, "total_idps", "settlement_id").select(
        "settlement_id",
        "total_idps",
        F.col("first_row").alias("rank_by_total"),
        ntile_from(4).alias("quartile"),
        round_half_up(percent_rank_from(reverse=True) * F.lit(100.0), 1).alias("percentile"),
    )


def d2_median_by_province_round(t: Tables) -> DataFrame:
    """The positional median of arrivals (the value at COUNT(*) div 2) of every province and round."""
    rows = with_geo(_obs(t), t).select("province_id", "round_id", "idp_arrivals")
    medians = kth_in(rows, ["province_id", "round_id"], "idp_arrivals", out="median_arrivals")
    return medians.join(province_labels(t), "province_id").orderBy("province_id", "round_id").select("province_name", "round_id", "median_arrivals")


def w4_top3_per_province(t: Tables, round_id: int = LATEST_ROUND, n: int = 3) -> DataFrame:
    o = with_geo(_obs(t).where(F.col("round_id") == round_id), t).select(
        "settlement_id", "district_id", "province_id", "idp_arrivals", "security_situation", "humanitarian_aid_delivered"
    )
    top = top_n_per(o, ["province_id"], [F.col("idp_arrivals").desc_nulls_last(), F.col("settlement_id")], n, "province_rank")
    out = attach_labels(top, t, ("settlement_name",), district=True, province=True)
    return out.orderBy("province_name", "province_rank", "province_id").select(
        "province_name",
        "province_rank",
        "settlement_name",
        "district_name",
        "idp_arrivals",
        "security_situation",
        yes_no("humanitarian_aid_delivered").alias("aid_delivered"),
    )


def c1x_deteriorated(t: Tables, a: int = 1, b: int = LATEST_ROUND, k: int = 30) -> DataFrame:
    cmp = period_compare(
        _obs(t),
        "settlement_id",
        "round_id",
        a,
        b,
        {"idp_arrivals": "idp", "security_situation": "sec", "humanitarian_aid_delivered": "aid"},
    )
    worse = cmp.where((F.col("idp_b") > F.col("idp_a")) & (F.col("sec_b") > F.col("sec_a")) & (F.col("aid_b") < F.col("aid_a")))
    worse = with_geo(worse, t).select(
        "settlement_id",
        "district_id",
        "province_id",
        F.col("idp_a").alias("idp_r1"),
        F.col("idp_b").alias("idp_r6"),
        (F.col("idp_b") - F.col("idp_a")).alias("idp_change"),
        F.col("sec_a").alias("sec_r1"),
        F.col("sec_b").alias("sec_r6"),
        (F.col("sec_b") - F.col("sec_a")).alias("security_change"),
    )
    top = worse.orderBy(F.col("idp_change").desc_nulls_last(), F.col("settlement_id")).limit(k)
    out = attach_labels(top, t, ("settlement_name",), district=True, province=True)
    return out.orderBy(_down("idp_change"), "settlement_id").select(
        "province_name", "district_name", "settlement_name", "idp_r1", "idp_r6", "idp_change", "sec_r1", "sec_r6", "security_change"
    )


def c2x_vulnerability_index(t: Tables) -> DataFrame:
    """Composite index ((idp/max)*25 + (sec/max)*25 + health_gap*20 + school_gap*15 +
    aid_gap*15) * 100. The weights already total 100, so the index runs 0-10,000, not
    0-100; the formula is kept as specified."""
    m = with_geo(_obs(t), t).groupBy("province_id").agg(
        F.avg("idp_arrivals").alias("avg_idp"),
        F.avg("security_situation").alias("avg_sec"),
        (F.lit(1) - F.avg("health_clinics_available")).alias("health_gap"),
        (F.lit(1) - F.avg("schools_available")).alias("school_gap"),
        (F.lit(1) - F.avg("humanitarian_aid_delivered")).alias("aid_gap"),
    )
    m = m.join(province_labels(t), "province_id")
    index = composite_index(
        {"avg_idp": 25, "avg_sec": 25, "health_gap": 20, "school_gap": 15, "aid_gap": 15}, {"avg_idp", "avg_sec"}
    )
    return m.select(
        "province_id",
        "province_name",
        round_half_up("avg_idp", 1).alias("avg_idp_arrivals"),
        round_half_up("avg_sec", 3).alias("avg_security_score"),
        round_half_up(F.col("health_gap") * F.lit(100.0), 1).alias("health_gap_pct"),
        round_half_up(F.col("school_gap") * F.lit(100.0), 1).alias("school_gap_pct"),
        round_half_up(F.col("aid_gap") * F.lit(100.0), 1).alias("aid_gap_pct"),
        round_half_up(index, 2).alias("vulnerability_index"),
    ).orderBy(_down("vulnerability_index"), "province_id").drop("province_id")


def did_group_means(t: Tables) -> DataFrame:
    agg = did_cells(
        _obs(t),
        "post_intervention",
        "diff_in_diff",
        F.count(F.lit(1)).alias("observations"),
        mean_r("idp_arrivals", 2).alias("avg_idp_arrivals"),
        mean_r("security_situation", 3).alias("avg_security"),
        pct("humanitarian_aid_delivered").alias("pct_aid_delivered"),
        pct("health_clinics_available").alias("pct_health_access"),
        pct("schools_available").alias("pct_school_access"),
    )
    return agg.orderBy(_up("diff_in_diff"), _up("post_intervention")).select(
        _did_label(DID_LABELS_PADDED).alias("group_label"),
        "observations",
        "avg_idp_arrivals",
        "avg_security",
        "pct_aid_delivered",
        "pct_health_access",
        "pct_school_access",
    )


def did_estimator(t: Tables) -> DataFrame:
    d = did_estimate(_obs(t), "post_intervention", "diff_in_diff", "idp_arrivals")
    return d.select(
        round_half_up("did", 4).alias("did_estimator_idp_arrivals"),
        round_half_up(treated_change(), 2).alias("treatment_group_change"),
        round_half_up(control_change(), 2).alias("control_group_change"),
    )


def did_by_province(t: Tables) -> DataFrame:
    d = did_estimate(with_geo(_obs(t), t), "post_intervention", "diff_in_diff", "idp_arrivals", by=["province_id"])
    d = d.where(F.col("did").isNotNull())  # all four cells are there
    return d.join(province_labels(t), "province_id").select(
        "province_id",
        "province_name",
        round_half_up("did", 2).alias("did_estimate"),
        F.when(F.col("did") < 0, F.lit(DID_REDUCED)).when(F.col("did") > 0, F.lit(DID_INCREASED)).otherwise(F.lit(DID_NONE)).alias(
            "interpretation"
        ),
    ).orderBy("did_estimate", "province_id").drop("province_id")


def l1_top_trajectories(t: Tables, k: int = 10) -> DataFrame:
    # Top units over ALL observations (no geo join), as in the report's contract. Place and
    # names are attached to the k units; that frame of at most k rows is broadcast to the fact.
    top = top_units(_obs(t), "settlement_id", mean_r("idp_arrivals", 0), k).withColumnRenamed("_score", "avg_idp")
    top = attach_labels(with_geo(top, t), t, ("settlement_code", "settlement_name"), province=True)
    rows = with_rounds(_obs(t).join(F.broadcast(top), "settlement_id"), t, "round_label", "round_period")
    return rows.orderBy(_down("avg_idp"), "round_id", "settlement_id", "observation_id").select(
        "settlement_code",
        "settlement_name",
        "province_name",
        "round_label",
        "round_period",
        "idp_arrivals",
        "security_situation",
        yes_no("humanitarian_aid_delivered").alias("aid"),
        yes_no("health_clinics_available").alias("health"),
        yes_no("schools_available").alias("schools"),
    )


def l2_surges(t: Tables, factor: float = 1.5, k: int = 30) -> DataFrame:
    s = surges(
        _obs(t).select("settlement_id", "round_id", "observation_id", "idp_arrivals"),
        "settlement_id",
        "round_id",
        "idp_arrivals",
        factor,
        "arrivals_before",
        tiebreak="observation_id",
        segmented=t.unit_key_bounded is False,
    )
    s = s.withColumn(
        "pct_increase",
        round_half_up(safe_div((F.col("idp_arrivals") - F.col("arrivals_before")).cast("double") * F.lit(100.0), F.col("arrivals_before")), 1),
    )
    s = with_rounds(with_geo(s, t), t, "round_label")
    order = [_down("pct_increase"), F.col("settlement_id"), F.col("round_id"), F.col("observation_id")]
    top = s.orderBy(*order).limit(k)
    out = attach_labels(top, t, ("settlement_name",), district=True, province=True)
    return out.orderBy(*order).select(
        "province_name",
        "district_name",
        "settlement_name",
        F.col("round_label").alias("surge_round"),
        "arrivals_before",
        F.col("idp_arrivals").alias("arrivals_after"),
        "pct_increase",
    )


# ── views ────────────────────────────────────────────────────────────────────────────

v1_settlement_full = views.v1_settlement_full
v2_observations_full = views.v2_observations_full
v3_province_summary = views.v3_province_summary


def v4_national_dashboard(t: Tables) -> DataFrame:
    return views.v4_national_dashboard(t).orderBy("round_id")


def v5_aid_gap(t: Tables) -> DataFrame:
    rows = views.aid_gap_rows(t)
    return rows.orderBy(_down("priority_score"), "settlement_id", "observation_id").drop("settlement_id", "observation_id")


# ── highlight reports ────────────────────────────────────────────────────────────────


def _with_province_name(t: Tables, df: DataFrame) -> DataFrame:
    return with_geo(df, t).join(province_labels(t), "province_id")


def s1_top_provinces(t: Tables, round_id: int = LATEST_ROUND, k: int = 10) -> DataFrame:
    o = _with_province_name(t, _obs(t).where(F.col("round_id") == round_id))
    agg = o.groupBy("province_name").agg(  # grouped by name, as specified
        F.sum("idp_arrivals").cast("long").alias("total_idps"),
        F.countDistinct("settlement_id").alias("settlements"),
        mean_r("security_situation", 2).alias("avg_security"),
    )
    return agg.orderBy(F.col("total_idps").desc_nulls_last(), F.col("province_name")).limit(k)


def s2_aid_tiers(t: Tables) -> DataFrame:
    agg = _with_province_name(t, _obs(t)).groupBy("province_name").agg(F.avg("humanitarian_aid_delivered").alias("_avg"))
    return agg.select(
        "province_name",
        round_half_up(F.col("_avg") * F.lit(100.0), 1).alias("aid_coverage_pct"),
        tier("_avg", COVERAGE_TIERS, COVERAGE_ELSE).alias("coverage_tier"),
    ).orderBy(_down("aid_coverage_pct"), "province_name")


def s3_districts_always_aided(t: Tables, n_rounds: int = N_ROUNDS) -> DataFrame:
    # The two distinct counts are two aggregations: one aggregate with both would copy every row.
    aided = with_geo(_obs(t).where(F.col("humanitarian_aid_delivered") == 1), t)
    rounds = aided.groupBy("district_id").agg(F.countDistinct("round_id").alias("rounds_with_full_aid"))
    units = aided.groupBy("district_id").agg(F.countDistinct("settlement_id").alias("settlements"))
    agg = rounds.where(F.col("rounds_with_full_aid") == n_rounds).join(units, "district_id")
    named = agg.join(district_labels(t), "district_id").orderBy(_down("settlements"), "district_id")
    return named.select("province_name", "district_name", "settlements", "rounds_with_full_aid")


def s4_surge_r4_r5(t: Tables, a: int = 4, b: int = 5, k: int = 15) -> DataFrame:
    cmp = period_compare(_obs(t), "settlement_id", "round_id", a, b, {"idp_arrivals": "idp"}).where(F.col("idp_b") > F.col("idp_a"))
    cmp = with_geo(cmp, t).select(
        "settlement_id",
        "district_id",
        "province_id",
        F.col("idp_a").alias("idp_r4"),
        F.col("idp_b").alias("idp_r5"),
        (F.col("idp_b") - F.col("idp_a")).alias("absolute_increase"),
        round_half_up(safe_div((F.col("idp_b") - F.col("idp_a")).cast("double") * F.lit(100.0), F.col("idp_a")), 1).alias("pct_increase"),
    )
    top = cmp.orderBy(F.col("absolute_increase").desc_nulls_last(), F.col("settlement_id")).limit(k)
    out = attach_labels(top, t, ("settlement_name",), district=True, province=True)
    out = out.orderBy(_down("absolute_increase"), "settlement_id")
    return out.select("province_name", "district_name", "settlement_name", "idp_r4", "idp_r5", "absolute_increase", "pct_increase")


def s5_multi_rank(t: Tables, k: int = 15) -> DataFrame:
    m = with_geo(_obs(t), t).groupBy("province_id").agg(
        F.avg("idp_arrivals").alias("avg_idp"),
        F.avg("security_situation").alias("avg_sec"),
        (F.lit(1) - F.avg("humanitarian_aid_delivered")).alias("aid_gap"),
    )
    m = m.join(province_labels(t), "province_id")
    ranked = composite_rank(
        m,
        {
            "rank_displacement": F.col("avg_idp").desc_nulls_last(),
            "rank_insecurity": F.col("avg_sec").desc_nulls_last(),
            "rank_aid_gap": F.col("aid_gap").desc_nulls_last(),
        },
    )
    top = ranked.orderBy(F.col("composite_rank_sum"), F.col("province_id")).limit(k)
    return top.select(
        "province_name",
        round_half_up("avg_idp", 1).alias("avg_idp_arrivals"),
        round_half_up("avg_sec", 3).alias("avg_security"),
        round_half_up(F.col("aid_gap") * F.lit(100.0), 1).alias("aid_gap_pct"),
        "rank_displacement",
        "rank_insecurity",
        "rank_aid_gap",
        "composite_rank_sum",
    )


def s6_did_report(t: Tables) -> DataFrame:
    # Means rounded to 4 dp before differencing, all four from one aggregation.
    d = did_estimate(_obs(t), "post_intervention", "diff_in_diff", "idp_arrivals", round_first=4)
    names = {CELLS[cell]: label for cell, label in DID_LABELS.items()}
    wide = d.select(*[F.col(c).alias(n) for c, n in names.items()], round_half_up("did", 4).alias(DID_ESTIMATOR_LABEL))
    return wide.unpivot([], [*names.values(), DID_ESTIMATOR_LABEL], "group_label", "mean_idp")


def s7_school_trend(t: Tables) -> DataFrame:
    dash = views.v4_national_dashboard(t)
    prev = F.lag("school_access_pct").over(Window.orderBy("round_id"))  # one row per round
    return dash.select(
        "round_id",
        "round_label",
        "round_period",
        "total_idp_arrivals",
        "national_aid_coverage_pct",
        "health_access_pct",
        "school_access_pct",
        "triply_deprived_settlements",
        F.when(F.col("school_access_pct") < prev, F.lit(TREND_DECLINED))
        .when(F.col("school_access_pct") > prev, F.lit(TREND_IMPROVED))
        .otherwise(F.lit(TREND_STABLE))
        .alias("school_trend"),
    ).orderBy("round_id").drop("round_id")


def s8_north_filter(t: Tables, min_lat: float = 36.0, k: int = 20) -> DataFrame:
    north = geo_filter(settlement_full(t), min_lat=min_lat).select(
        "settlement_id", "province_name", "district_name", "settlement_name", "latitude", "longitude"
    )
    agg = (
        _obs(t)
        .join(north.select("settlement_id"), "settlement_id")
        .groupBy("settlement_id")
        .agg(F.sum("idp_arrivals").cast("long").alias("total_idps_all_rounds"), mean_r("security_situation", 2).alias("avg_security"))
    )
    top = agg.orderBy(F.col("total_idps_all_rounds").desc_nulls_last(), F.col("settlement_id")).limit(k)
    named = F.broadcast(top).join(north, "settlement_id").orderBy(_down("total_idps_all_rounds"), "settlement_id")
    return named.select(
        "province_name", "district_name", "settlement_name", "latitude", "longitude", "total_idps_all_rounds", "avg_security"
    )


# ── the same data by other ways in: a view's name, CSV files, a flat extract ─────────────


def v4_by_name(t: Tables) -> DataFrame:
    """The national dashboard as a SQL user reads it: by the name of its view."""
    views.register_views(t)
    return t.observations.sparkSession.sql("SELECT * FROM vw_national_dashboard ORDER BY round_id")


def s2_csv_province_burden(t: Tables) -> DataFrame:
    """The tables written as CSV with a header and loaded again with their declared types."""
    spark = t.observations.sparkSession
    path = scratch_path(spark, "csv")
    for name in TABLE_NAMES:
        t[name].write.option("header", True).csv(f"{path}/{name}.csv")
    return q2a_province_burden(load_tables(spark, path, fmt="csv"))


def s9_flat_roundtrip(t: Tables) -> DataFrame:
    """The panel flattened, normalised again, and shown by codes: every observation comes back."""
    n = normalize_flat(_flat(t))
    places = n.settlements.join(n.districts, "adm2_code").select("settlement_id", "settlement_code", "adm2_code")
    rows = n.observations.join(places, "settlement_id").join(n.small("survey_rounds"), "round_id")
    return rows.select(
        "settlement_code", "adm2_code", "round_id", "round_label", "idp_arrivals", "change_idp_arrivals", "host_population", "security_situation"
    )


def _flat(t: Tables) -> DataFrame:
    more = t.settlements.select("settlement_code", "adm2_code", "pashtun_greg", "pashtun_ethno")
    return views.v2_observations_full(t, more)


def s9_incremental_load(t: Tables) -> DataFrame:
    """The flattened panel in two loads: first without the settlements whose code ends in 1, 2 or 3,
    then all of it, with some codes and labels missing. Every row of both loads comes back once,
    with its ids or the reason why it was rejected."""
    spark = t.observations.sparkSession
    flat, last = _flat(t), F.right("settlement_code", F.lit(1))
    store = FlatStore(spark, scratch_path(spark, "flat-store"))
    store.append(flat.where(~last.isin("1", "2", "3")))
    no_code = F.when(last != "7", F.col("settlement_code"))
    no_label = F.when(last != "8", F.col("round_label"))
    store.append(flat.withColumns({"settlement_code": no_code, "round_label": no_label}))
    n = store.tables()
    codes = n.settlements.select("settlement_id", "settlement_code")
    taken = store.observations().join(codes, "settlement_id").join(n.small("survey_rounds"), "round_id")
    ids = ["settlement_id", "round_id", "observation_id"]
    shown = ["load", "settlement_code", "round_label", "idp_arrivals", *ids]
    away = store.rejected().select(*[c for c in shown if c not in ids], "reason")
    return taken.select(*shown).unionByName(away, allowMissingColumns=True)


def s2_checked_load(t: Tables) -> DataFrame:
    """The tables as CSV, with faults in rows picked by id, loaded with a reject table: accepted
    and rejected lines by table and rule."""
    spark = t.observations.sparkSession
    path = scratch_path(spark, "faulty-csv")
    faults = {
        "observations": {
            "idp_arrivals": F.when(F.col("observation_id") % 101 == 0, "n/a"),
            "security_situation": F.when(F.col("observation_id") % 103 == 0, "9"),
            "round_id": F.when(F.col("observation_id") % 107 == 0, "99"),
            "settlement_id": F.when(F.col("observation_id") % 109 == 0, ""),
        },
        "settlements": {"adm2_code": F.when(F.col("settlement_id") % 53 == 0, "nowhere")},
    }
    for name in TABLE_NAMES:
        rows = t[name]
        if name == "observations":
            copies = F.when(F.col("observation_id") % 113 == 0, 2).otherwise(1)
            rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
        wrong = faults.get(name, {})
        shown = [F.coalesce(wrong[c], F.col(c).cast("string")).alias(c) if c in wrong else F.col(c) for c in rows.columns]
        rows.select(*shown).write.option("header", True).option("emptyValue", "").csv(f"{path}/{name}.csv")
    load = load_checked(spark, path)
    accepted = None
    for name in TABLE_NAMES:
        counted = load.tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit("accepted").alias("rule"), "n")
        accepted = counted if accepted is None else accepted.unionByName(counted)
    rejected = load.rejected.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("n"))
    return accepted.where("n > 0").unionByName(rejected).select("table_name", "rule", F.col("n").alias("lines"))


# ── lookups in layouts that skip ─────────────────────────────────────────────────────


def s6_clustered_lookup(t: Tables) -> DataFrame:
    """One province's observations of the latest round, from the fact in z-order of round and place."""
    spark = t.observations.sparkSession
    path = scratch_path(spark, "clustered")
    write_clustered(t, path)
    rows = spark.read.parquet(path).where((F.col("round_id") == LATEST_ROUND) & (F.col("province_id") == 3))
    return rows.select("observation_id", "settlement_id", "district_id", "idp_arrivals", "security_situation")


def p15_box_lookup(t: Tables) -> DataFrame:
    """Settlements within a four-sided box, from the settlements in grid order."""
    spark = t.observations.sparkSession
    path = scratch_path(spark, "gridded")
    write_gridded(t.settlements, path)
    box = Box(south=31.5, north=36.0, west=62.5, east=66.25)
    return box_filter(spark.read.parquet(path), box).select("settlement_id", "settlement_code", "latitude", "longitude")


# ── the summary views from stored states ─────────────────────────────────────────────


def _stored(t: Tables) -> ViewStore:
    """A store of the panel whose latest round was incomplete, then refreshed."""
    spark = t.observations.sparkSession
    store = ViewStore(spark, scratch_path(spark, "view-store"))
    early = (F.col("round_id") != LATEST_ROUND) | (F.col("observation_id") % 2 == 0)
    store.refresh(t.with_observations(t.observations.where(early)))
    store.refresh(t)
    return store


def v3_stored(t: Tables) -> DataFrame:
    return _stored(t).province_summary(t)


def v4_stored(t: Tables) -> DataFrame:
    return _stored(t).national_dashboard(t).orderBy("round_id")


def q2a_stored(t: Tables) -> DataFrame:
    return _stored(t).province_burden(t).orderBy(_down("total_idp_arrivals"), "province_name")


def s1_stored(t: Tables) -> DataFrame:
    return _stored(t).top_provinces(t, LATEST_ROUND, 10)


# ── declared constraints as audits ───────────────────────────────────────────────────


def dq_not_null(t: Tables) -> DataFrame:
    return audit.audit_not_null(t)


def dq_unique_keys(t: Tables) -> DataFrame:
    return audit.audit_unique(t)


def dq_foreign_keys(t: Tables) -> DataFrame:
    return audit.audit_fk(t)


def dq_value_domains(t: Tables) -> DataFrame:
    return audit.audit_domains(t)


def dq_unbalanced_units(t: Tables) -> DataFrame:
    return audit.unbalanced_units(t.observations, t.survey_rounds)


REPORTS = {
    name: fn
    for name, fn in [
        ("a1_row_counts", a1_row_counts),
        ("a2_rounds_context", a2_rounds_context),
        ("a3_panel_balance", a3_panel_balance),
        ("b1_coverage_province", b1_coverage_province),
        ("b2_top_districts", b2_top_districts),
        ("c1_null_audit", c1_null_audit),
        ("c2_null_by_round", c2_null_by_round),
        ("d1_security_distribution", d1_security_distribution),
        ("d2_idp_summary", d2_idp_summary),
        ("d2_median_by_province_round", d2_median_by_province_round),
        ("d3_aid_type_shares", d3_aid_type_shares),
        ("d4_did_group_sizes", d4_did_group_sizes),
        ("q1a_idp_by_round", q1a_idp_by_round),
        ("q1b_round_change", q1b_round_change),
        ("q1c_persistent_high", q1c_persistent_high),
        ("q1c_persistent_high_t500", q1c_persistent_high_t500),
        ("q2a_province_burden", q2a_province_burden),
        ("q2b_province_pivot", q2b_province_pivot),
        ("q2c_district_burden_latest", q2c_district_burden_latest),
        ("q3a_security_by_round", q3a_security_by_round),
        ("q3b_insecure_provinces", q3b_insecure_provinces),
        ("q3c_security_vs_idp", q3c_security_vs_idp),
        ("q4a_aid_by_round", q4a_aid_by_round),
        ("q4b_aid_by_province", q4b_aid_by_province),
        ("q4c_aid_gap_rows", q4c_aid_gap_rows),
        ("q5a_services_by_round", q5a_services_by_round),
        ("q5b_low_service_provinces", q5b_low_service_provinces),
        ("q5c_triple_deprivation", q5c_triple_deprivation),
        ("w1_panel_longitudinal", w1_panel_longitudinal),
        ("w1_panel_full", w1_panel_full),
        ("lead_next_round", lead_next_round),
        ("w2_moving_avg_security", w2_moving_avg_security),
        ("w2_moving_avg_settlement", w2_moving_avg_settlement),
        ("w3_province_percentiles", w3_province_percentiles),
        ("w3_settlement_percentiles", w3_settlement_percentiles),
        ("w4_top3_per_province", w4_top3_per_province),
        ("c1x_deteriorated", c1x_deteriorated),
        ("c2x_vulnerability_index", c2x_vulnerability_index),
        ("did_group_means", did_group_means),
        ("did_estimator", did_estimator),
        ("did_by_province", did_by_province),
        ("l1_top_trajectories", l1_top_trajectories),
        ("l2_surges", l2_surges),
        ("v1_settlement_full", v1_settlement_full),
        ("v2_observations_full", v2_observations_full),
        ("v3_province_summary", v3_province_summary),
        ("v4_national_dashboard", v4_national_dashboard),
        ("v5_aid_gap", v5_aid_gap),
        ("s1_top_provinces", s1_top_provinces),
        ("s2_aid_tiers", s2_aid_tiers),
        ("s3_districts_always_aided", s3_districts_always_aided),
        ("s4_surge_r4_r5", s4_surge_r4_r5),
        ("s5_multi_rank", s5_multi_rank),
        ("s6_did_report", s6_did_report),
        ("s7_school_trend", s7_school_trend),
        ("s8_north_filter", s8_north_filter),
        ("v4_by_name", v4_by_name),
        ("s2_csv_province_burden", s2_csv_province_burden),
        ("s9_flat_roundtrip", s9_flat_roundtrip),
        ("s9_incremental_load", s9_incremental_load),
        ("s2_checked_load", s2_checked_load),
        ("s6_clustered_lookup", s6_clustered_lookup),
        ("p15_box_lookup", p15_box_lookup),
        ("v3_stored", v3_stored),
        ("v4_stored", v4_stored),
        ("q2a_stored", q2a_stored),
        ("s1_stored", s1_stored),
        ("dq_not_null", dq_not_null),
        ("dq_unique_keys", dq_unique_keys),
        ("dq_foreign_keys", dq_foreign_keys),
        ("dq_value_domains", dq_value_domains),
        ("dq_unbalanced_units", dq_unbalanced_units),
    ]
}
