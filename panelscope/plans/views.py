"""The five reusable views, as functions returning unsorted DataFrames (a view's ORDER BY
is left to the consumer). Register them with ``register_views`` to query them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.functions.expr import SECURITY_LABELS, count_where, label_levels, mean_r, pct
from panelscope.operators.geo import province_labels, settlement_full, with_geo, with_rounds
from panelscope.operators.score import priority_score
from panelscope.sources.schema import AID_FLAGS, RESOLUTION_COLS, SERVICE_FLAGS, TABLE_NAMES
from panelscope.sources.tables import LABEL_BROADCAST_MAX_ROWS, Tables


def v1_settlement_full(t: Tables) -> DataFrame:
    return settlement_full(t)


def v2_observations_full(t: Tables, more: DataFrame | None = None) -> DataFrame:
    """Flat, denormalised observations: geography, round labels, all measures. ``more`` columns by
    settlement_code are joined to the settlements, before these meet their observations."""
    sf = settlement_full(t).select(
        "settlement_id", "settlement_code", "settlement_name", "district_name", "province_name", "adm1_code", "longitude", "latitude"
    )
    if more is not None:
        sf = sf.join(more, "settlement_code")
    # Above the limit: a sort-merge join of the two tables bucketed on settlement_id.
    if t.rows("settlements") <= LABEL_BROADCAST_MAX_ROWS:
        sf = F.broadcast(sf)
    o = with_rounds(t.observations.join(sf, "settlement_id"), t, "round_label", "round_period")
    return o.select(
        "observation_id",
        "settlement_code",
        "settlement_name",
        "district_name",
        "province_name",
        "adm1_code",
        "longitude",
        "latitude",
        "round_id",
        "round_label",
        "round_period",
        "host_population",
        "idp_arrivals",
        "change_idp_arrivals",
        "idp_conflict_severity",
        "idp_disaster_severity",
        "security_situation",
        label_levels("security_situation", SECURITY_LABELS).alias("security_label"),
        *SERVICE_FLAGS,
        *AID_FLAGS,
        "post_intervention",
        "diff_in_diff",
        *RESOLUTION_COLS,
        *[c for c in (more.columns if more is not None else []) if c != "settlement_code"],
    )


def v3_province_summary(t: Tables) -> DataFrame:
    """Province x round dashboard."""
    o = with_rounds(with_geo(t.observations, t), t)
    agg = o.groupBy("round_id", "province_id").agg(
        F.countDistinct("settlement_id").alias("settlements_assessed"),
        F.sum("idp_arrivals").cast("long").alias("total_idp_arrivals"),
        mean_r("idp_arrivals", 1).alias("avg_idp_per_settlement"),
        F.max("idp_arrivals").alias("max_idp_settlement"),
        mean_r("security_situation", 3).alias("avg_security_score"),
        count_where(F.col("security_situation") >= 4).alias("high_threat_count"),
        pct("humanitarian_aid_delivered").alias("pct_aid_delivered"),
        pct("health_clinics_available").alias("pct_health_access"),
        pct("schools_available").alias("pct_school_access"),
        pct("aid_food_distribution").alias("pct_food_aid"),
        pct("aid_cash").alias("pct_cash_aid"),
        pct("aid_emergency_shelter").alias("pct_shelter_aid"),
    )
    return (
        with_rounds(agg, t, "round_label", "round_period")
        .join(province_labels(t), "province_id")
        .select(
            "round_id",
            "round_label",
            "round_period",
            "province_id",
            "province_name",
            "settlements_assessed",
            "total_idp_arrivals",
            "avg_idp_per_settlement",
            "max_idp_settlement",
            "avg_security_score",
            "high_threat_count",
            "pct_aid_delivered",
            "pct_health_access",
            "pct_school_access",
            "pct_food_aid",
            "pct_cash_aid",
            "pct_shelter_aid",
        )
    )


def v4_national_dashboard(t: Tables) -> DataFrame:
    """One row per round: national KPIs. Aggregated per round_id first (partial
    aggregation; the shuffle carries one row per round per task), labels joined after."""
    agg = t.observations.groupBy("round_id").agg(
        F.countDistinct("settlement_id").alias("settlements_surveyed"),
        F.sum("idp_arrivals").cast("long").alias("total_idp_arrivals"),
        mean_r("idp_arrivals", 1).alias("avg_idp_per_settlement"),
        mean_r("security_situation", 3).alias("national_avg_security"),
        count_where(F.col("security_situation") >= 4).alias("high_threat_settlements"),
        pct("humanitarian_aid_delivered").alias("national_aid_coverage_pct"),
        pct("health_clinics_available").alias("health_access_pct"),
        pct("schools_available").alias("school_access_pct"),
        pct("aid_food_distribution").alias("food_aid_pct"),
        pct("aid_cash").alias("cash_aid_pct"),
        pct("aid_emergency_shelter").alias("shelter_aid_pct"),
        pct("aid_infrastructure").alias("infra_aid_pct"),
        count_where(F.col("idp_conflict_severity") >= 4).alias("high_conflict_displacement"),
        count_where(F.col("idp_disaster_severity") >= 4).alias("high_disaster_displacement"),
        count_where(
            (F.col("health_clinics_available") == 0)
            & (F.col("schools_available") == 0)
            & (F.col("humanitarian_aid_delivered") == 0)
        ).alias("triply_deprived_settlements"),
    )
    cols = [c for c in agg.columns if c != "round_id"]
    return with_rounds(agg, t, "round_label", "round_period").select("round_id", "round_label", "round_period", *cols)


def v5_aid_gap(t: Tables, round_id: int = 6, min_arrivals: int = 500) -> DataFrame:
    """Unaided settlements with high displacement in the latest round, with the integer
    priority score."""
    return aid_gap_rows(t, round_id, min_arrivals).drop("settlement_id", "observation_id")


def aid_gap_rows(t: Tables, round_id: int = 6, min_arrivals: int = 500) -> DataFrame:
    """The same with its ids. The round predicate prunes the fact's round partitions."""
    o = t.observations.where(
        (F.col("round_id") == round_id) & (F.col("humanitarian_aid_delivered") == 0) & (F.col("idp_arrivals") > min_arrivals)
    )
    sf = settlement_full(t).select(
        "settlement_id", "province_name", "district_name", "settlement_code", "settlement_name", "latitude", "longitude"
    )
    if t.rows("settlements") <= LABEL_BROADCAST_MAX_ROWS:
        sf = F.broadcast(sf)
    return o.join(sf, "settlement_id").select(
        "settlement_id",
        "observation_id",
        "province_name",
        "district_name",
        "settlement_code",
        "settlement_name",
        "latitude",
        "longitude",
        "idp_arrivals",
        "idp_conflict_severity",
        "idp_disaster_severity",
        "security_situation",
        "health_clinics_available",
        "schools_available",
        priority_score().alias("priority_score"),
    )


VIEWS = {
    "vw_settlement_full": v1_settlement_full,
    "vw_observations_full": v2_observations_full,
    "vw_province_summary": v3_province_summary,
    "vw_national_dashboard": v4_national_dashboard,
    "vw_aid_gap": v5_aid_gap,
}


def register_views(t: Tables, replace: bool = True) -> list[str]:
    """Register the five tables and the five views as temp views, replacing those of the names;
    with ``replace`` off as CREATE VIEW IF NOT EXISTS does: a name that exists stays as it is.
    Returns the names registered."""
    spark = t.observations.sparkSession
    made = []
    for name in [*TABLE_NAMES, *VIEWS]:
        if replace or not spark.catalog.tableExists(name):
            (t[name] if name in TABLE_NAMES else VIEWS[name](t)).createOrReplaceTempView(name)
            made.append(name)
    return made


def register_reports(t: Tables, prefix: str = "report_") -> list[str]:
    """Register every report as a temp view ``{prefix}{key}`` (plus the tables and views),
    so SQL users can ``SELECT * FROM report_q2a_province_burden``. Views are lazy: each
    query runs the report's plan."""
    from panelscope.plans.reports import REPORTS

    register_views(t)
    names = []
    for key, fn in REPORTS.items():
        fn(t).createOrReplaceTempView(prefix + key)
        names.append(prefix + key)
    return names
