"""Difference-in-differences on the panel's two 0/1 flags (post period, treatment).

All four cell means come out of ONE aggregation: AVG(CASE WHEN cell THEN y END) per cell,
instead of one scan per cell reference. A missing cell gives NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.expr import round_half_up

# (post, treatment) -> column name of the cell's mean.
CELLS = {(1, 1): "treated_after", (0, 1): "treated_before", (1, 0): "control_after", (0, 0): "control_before"}


def did_cells(df: DataFrame, post: str, treat: str, *aggs: Column) -> DataFrame:
    """Per-cell aggregates: GROUP BY post, treatment."""
    return df.groupBy(post, treat).agg(*aggs)


def cell_means(post: str, treat: str, y: str, digits: int | None = None) -> list[Column]:
    """AVG(y) restricted to each of the four cells, as the columns named in CELLS."""
    out = []
    for (p, t), name in CELLS.items():
        m = F.avg(F.when((F.col(post) == p) & (F.col(treat) == t), F.col(y)))
        out.append((round_half_up(m, digits) if digits is not None else m).alias(name))
    return out


def treated_change() -> Column:
    return F.col("treated_after") - F.col("treated_before")


def control_change() -> Column:
    return F.col("control_after") - F.col("control_before")


def did_estimate(df: DataFrame, post: str, treat: str, y: str, by: Sequence[str] = (), round_first: int | None = None) -> DataFrame:
    """One row per ``by`` group with the four cell means and ``did``, the treated group's change
    less the control group's. ``round_first`` rounds the means before differencing."""
    means = df.groupBy(*by).agg(*cell_means(post, treat, y, round_first)) if by else df.agg(
        *cell_means(post, treat, y, round_first)
    )
    return means.withColumn("did", treated_change() - control_change())
