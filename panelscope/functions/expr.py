"""Column-expression helpers. Everything here builds JVM-side expressions (no UDFs), so
it stays inside whole-stage codegen.

Numeric conventions (the reports were written for an engine with these rules):
* ``ROUND`` is half-away-from-zero on the decimal value: ``round_half_up`` rounds through
  ``DECIMAL(28,10)`` so that e.g. 23/40 -> 0.58 at 2 dp, whatever the binary double is.
* ``x * 100.0`` is a double: literals are Python floats (``DoubleType``), never decimals.
* Division by zero yields NULL (``safe_div``), integer ``/`` truncates (``int_div``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 0-5 security scale labels used by several reports and views.
SECURITY_LABELS = {
    0: "No Threat",
    1: "Minimal",
    2: "Low",
    3: "Moderate",
    4: "High",
    5: "Extreme",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col: Column | str, digits: int) -> Column:
    """ROUND(x, digits) half away from zero on the decimal value, returned as DOUBLE."""
    return F.round(_c(col).cast("decimal(28,10)"), digits).cast("double")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den with NULL (not an error) when den = 0; double result."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def int_div(num: Column | str, den: Column | str | int) -> Column:
    """Integer division truncating toward zero; NULL when den = 0. Exact for 64 bits."""
    den_c = F.lit(den) if isinstance(den, int) else _c(den)
    return F.call_function("div", _c(num), F.nullif(den_c, F.lit(0)))


def mean_r(col: Column | str, digits: int) -> Column:
    """ROUND(AVG(col), digits)."""
    return round_half_up(F.avg(_c(col)), digits)


def pct(flag: Column | str, digits: int = 1) -> Column:
    """ROUND(AVG(flag) * 100.0, digits): percentage of rows where a 0/1 flag is set."""
    return round_half_up(F.avg(_c(flag)) * F.lit(100.0), digits)


def pct_of(part: Column, whole: Column, digits: int) -> Column:
    """ROUND(part * 100.0 / whole, digits) with a NULL result for whole = 0."""
    return round_half_up(safe_div(part.cast("double") * F.lit(100.0), whole), digits)


def count_where(pred: Column) -> Column:
    """SUM(CASE WHEN pred THEN 1 ELSE 0 END): BIGINT, NULL on empty input."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("long")


def label_levels(col: Column | str, labels: Mapping[int, str]) -> Column:
    """Simple CASE col WHEN k THEN label ... END (no ELSE: unmatched and NULL -> NULL)."""
    c = _c(col)
    out = None
    for k, v in labels.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out


def tier(col: Column | str, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Searched CASE over descending thresholds: first ``col >= cut`` wins, else ``otherwise``.
    A NULL value falls through to ``otherwise``."""
    c = _c(col)
    out = None
    for cut, name in cuts:
        cond = c >= F.lit(cut)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def yes_no(flag: Column | str) -> Column:
    """CASE flag WHEN 1 THEN 'Yes' ELSE 'No' END (NULL -> 'No')."""
    return F.when(_c(flag) == F.lit(1), F.lit("Yes")).otherwise(F.lit("No"))
