"""Grouped indicators, pivots by period, shares of totals and persistence filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.expr import round_half_up, safe_div


def kpis_by(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """GROUP BY keys with the given aggregate columns. Spark plans a partial (map-side)
    aggregate before the shuffle, so a hot key is combined per task before it moves."""
    return df.groupBy(*keys).agg(*aggs)


def pivot_periods(
    df: DataFrame,
    keys: Sequence[str],
    period: str,
    measure: str,
    names: dict[int, str],
    total: str | None = None,
) -> DataFrame:
    """One column per listed period: SUM(measure) where period = p, NULL for an absent
    cell, plus an optional grand total. The periods are explicit, so no extra job is
    needed to discover them and the output schema is fixed."""
    aggs = [F.sum(F.when(F.col(period) == F.lit(p), F.col(measure))).cast("long").alias(n) for p, n in names.items()]
    if total:
        aggs.append(F.sum(measure).cast("long").alias(total))
    return df.groupBy(*keys).agg(*aggs)


def share_of_total(part: Column, total: Column, digits: int = 2) -> Column:
    """ROUND(part * 100.0 / total, digits); NULL when the total is 0."""
    return round_half_up(safe_div(part.cast("double") * F.lit(100.0), total), digits)


def total_over(col: str) -> Column:
    """SUM(col) over the whole (aggregated, dimension-bounded) frame."""
    return F.sum(col).over(Window.partitionBy())


def persistent(
    df: DataFrame,
    unit: str | list[str],
    period: str,
    pred: Column,
    n_periods: int,
    *aggs: Column,
    distinct: bool = False,
    periods: str = "periods",
) -> DataFrame:
    """Units whose rows satisfy ``pred`` in ``n_periods`` periods (HAVING COUNT(period) = n,
    or COUNT(DISTINCT period) with ``distinct``), with optional extra aggregates over the
    matching rows. ``unit`` may be several columns (a key and its dependent ids)."""
    keys = [unit] if isinstance(unit, str) else list(unit)
    cnt = F.countDistinct(period) if distinct else F.count(period)
    return df.where(pred).groupBy(*keys).agg(cnt.alias(periods), *aggs).where(F.col(periods) == n_periods)
