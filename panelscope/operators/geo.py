"""The settlement -> district -> province hierarchy.

Reports join the fact only to the *keys* of the hierarchy (settlement_id -> district_id,
province_id), aggregate, and attach names afterwards to the (small) aggregated result, so
label strings never travel through a shuffle. The inner-join chain keeps the reference
semantics: an observation whose settlement, district or province is missing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.sources.tables import GEO_BROADCAST_MAX_ROWS, LABEL_BROADCAST_MAX_ROWS, Tables


def geo_keys(t: Tables) -> DataFrame:
    """settlement_id, district_id, province_id for settlements with a full hierarchy
    (materialised at write time when the tables come from a bucketed store)."""
    return t.hierarchy()


def with_geo(df: DataFrame, t: Tables, how: str = "inner") -> DataFrame:
    """Attach district_id and province_id to rows keyed by settlement_id.

    The geo side is one row per settlement, i.e. it grows with the panel; it is broadcast
    only when the counted settlement table is under GEO_BROADCAST_MAX_ROWS. Otherwise it is
    a sort-merge join on settlement_id: without an exchange when both sides come from the
    bucketed store, by shuffling both sides when they do not (AQE splits skewed keys).
    """
    g = geo_keys(t)
    if t.rows("settlements") <= GEO_BROADCAST_MAX_ROWS:
        g = F.broadcast(g)
    return df.join(g, "settlement_id", how)


def with_rounds(df: DataFrame, t: Tables, *cols: str) -> DataFrame:
    """Inner join to survey_rounds on round_id, bringing ``cols`` (labels) along."""
    r = t.small("survey_rounds").select("round_id", *cols)
    return df.join(r, "round_id")


def province_labels(t: Tables, *cols: str) -> DataFrame:
    return t.small("provinces").select("province_id", *(cols or ("province_name",)))


def district_labels(t: Tables) -> DataFrame:
    """district_id -> district_name, province_name (districts with a province only)."""
    d = t.small("districts").select("district_id", "district_name", "province_id")
    return d.join(province_labels(t), "province_id").select("district_id", "district_name", "province_name")


def settlement_full(t: Tables) -> DataFrame:
    """Fully joined settlement profile (settlements x districts x provinces, inner)."""
    d = t.small("districts").select("adm2_code", "district_name", "province_id")
    p = t.small("provinces").select("province_id", "province_name", "adm1_code")
    return (
        t.settlements.join(d, "adm2_code")
        .join(p, "province_id")
        .select(
            "settlement_id",
            "settlement_code",
            "settlement_name",
            "longitude",
            "latitude",
            "adm2_code",
            "district_name",
            "province_id",
            "province_name",
            "adm1_code",
            "pashtun_greg",
            "pashtun_ethno",
        )
    )


def attach_labels(
    rows: DataFrame, t: Tables, settlement_cols=(), district=False, province=False, bounded: bool = True
) -> DataFrame:
    """Attach names to a *small* result (a top-k or aggregated frame), or to any with ``bounded=False``.

    ``rows`` must carry settlement_id / district_id / province_id as needed. A bounded result
    (an aggregate or a LIMIT) is the side that is broadcast when joining back to a settlement
    table too large for it; rows that grow with the panel are then joined by shuffle.
    """
    out = rows
    if settlement_cols:
        s = t.settlements.select("settlement_id", *settlement_cols)
        if t.rows("settlements") <= LABEL_BROADCAST_MAX_ROWS:
            out = out.join(F.broadcast(s), "settlement_id")
        else:
            out = (F.broadcast(out) if bounded else out).join(s, "settlement_id")
    if district:
        out = out.join(t.small("districts").select("district_id", "district_name"), "district_id")
    if province:
        out = out.join(province_labels(t), "province_id")
    return out


def geo_filter(
    df: DataFrame,
    min_lat: float | None = None,
    max_lat: float | None = None,
    min_lon: float | None = None,
    max_lon: float | None = None,
    strict: bool = True,
) -> DataFrame:
    """Bounding-box filter on latitude/longitude; every bound optional. NULL coordinates
    never pass. Written as plain comparisons so Parquet receives them as pushed filters."""
    cond = F.lit(True)
    lo = (lambda c, v: F.col(c) > v) if strict else (lambda c, v: F.col(c) >= v)
    hi = (lambda c, v: F.col(c) < v) if strict else (lambda c, v: F.col(c) <= v)
    if min_lat is not None:
        cond = cond & lo("latitude", min_lat)
    if max_lat is not None:
        cond = cond & hi("latitude", max_lat)
    if min_lon is not None:
        cond = cond & lo("longitude", min_lon)
    if max_lon is not None:
        cond = cond & hi("longitude", max_lon)
    return df.where(cond)
