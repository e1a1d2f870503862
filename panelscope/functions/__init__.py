from panelscope.functions.expr import (
    SECURITY_LABELS,
    count_where,
    int_div,
    label_levels,
    mean_r,
    pct,
    pct_of,
    round_half_up,
    safe_div,
    tier,
    yes_no,
)

__all__ = [
    "SECURITY_LABELS",
    "count_where",
    "int_div",
    "label_levels",
    "mean_r",
    "pct",
    "pct_of",
    "round_half_up",
    "safe_div",
    "tier",
    "yes_no",
]
