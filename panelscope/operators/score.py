"""Composite scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelscope.functions.expr import int_div, safe_div


def composite_index(weights: dict[str, float], normalise_by_max: set[str], scale: float = 100.0) -> Column:
    """(sum_i w_i * x_i') * scale, where x' = x / MAX(x) over the frame for the columns in
    ``normalise_by_max`` (NULL when that maximum is 0), x otherwise. The maximum is a
    window over the whole frame: apply to frames aggregated to a dimension (provinces).
    Terms are added left to right in ``weights`` order."""
    total = None
    for c, w in weights.items():
        x = F.col(c)
        if c in normalise_by_max:
            x = safe_div(x, F.max(c).over(Window.partitionBy()))
        term = x * F.lit(w)
        total = term if total is None else total + term
    return total * F.lit(float(scale))


def priority_score(
    idp: str = "idp_arrivals",
    conflict: str = "idp_conflict_severity",
    disaster: str = "idp_disaster_severity",
    security: str = "security_situation",
    health: str = "health_clinics_available",
    schools: str = "schools_available",
) -> Column:
    """Integer targeting score: idp div 100 + conflict*50 + disaster*30 + (5-security)*10
    + (1-health)*20 + (1-schools)*10. Integer arithmetic; any NULL input gives NULL."""
    return (
        int_div(F.col(idp), 100)
        + F.col(conflict).cast("long") * 50
        + F.col(disaster).cast("long") * 30
        + (F.lit(5) - F.col(security)).cast("long") * 10
        + (F.lit(1) - F.col(health)).cast("long") * 20
        + (F.lit(1) - F.col(schools)).cast("long") * 10
    ).cast("long")
