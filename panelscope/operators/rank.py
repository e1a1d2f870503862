"""Ranking operators.

Windows with a PARTITION BY on a geographic key put a whole group into one task, and a
province may hold a third of all rows. Ranks over fact rows are therefore computed from
a *histogram*: ``groupBy(group, value).count()`` is aggregated map-side (a hot value
collapses before the shuffle), and RANK() = 1 + number of rows with a strictly better
value in the group, a running sum over the group's distinct values only. Work per task
is bounded by the number of distinct measure values of a group, not by its rows.

Global windows (no PARTITION BY) are only applied to already aggregated frames whose
size is bounded by a dimension (rounds, provinces).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators.panel import _same_segment, _segments, _unit_names, unit_scan


def _better(h_val: Column, r_val: Column, desc: bool) -> Column:
    """h_val sorts strictly before r_val under ORDER BY value [DESC], NULLs smallest
    (NULLS LAST for DESC, NULLS FIRST for ASC)."""
    if desc:
        return h_val.isNotNull() & (r_val.isNull() | (h_val > r_val))
    return r_val.isNotNull() & (h_val.isNull() | (h_val < r_val))


def rank_in(df: DataFrame, group: Sequence[str], value: str, out: str = "rank", desc: bool = True, partitions: int | None = None) -> DataFrame:
    """RANK() OVER (PARTITION BY group ORDER BY value [DESC]) for every row, as BIGINT.

    RANK = 1 + rows of the group that sort strictly before the row. The (group, value)
    histogram is aggregated map-side, so neither a hot group nor a hot value moves its rows
    through one task; its running counts per group are a segmented scan (``unit_scan``), whose
    segments follow the values that are there: a group with any number of distinct values, in
    any distribution, is spread over them. NULLs sort last for DESC, first for ASC.
    """
    group = list(group)
    hist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = unit_scan(hist, group, [value], "_n", cum="_upto", partitions=partitions)  # ascending, NULLs first
    before = F.col("_upto") - F.col("_n")
    if desc:
        totals = hist.groupBy(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(group)]).agg(F.sum("_n").alias("_total"))
        same = F.lit(True)
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_t{i}"))
        upto = upto.join(totals, same)
        before = F.col("_total") - F.col("_upto")
    ranks = upto.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(value).alias("_v"), (before + 1).cast("long").alias(out)
    )
    cond = df[value].eqNullSafe(ranks["_v"])
    for i, g in enumerate(group):
        cond = cond & df[g].eqNullSafe(ranks[f"_g{i}"])
    return df.join(ranks, cond).drop("_v", *[f"_g{i}" for i in range(len(group))])


def rank_rows(
    rows: DataFrame,
    population: DataFrame,
    group: Sequence[str],
    value: str,
    out: str = "rank",
    desc: bool = True,
) -> DataFrame:
    """RANK() of a bounded set of ``rows`` within ``population``.

    For reports that display a LIMITed slice: the slice (bounded by its LIMIT, so it is
    broadcast) meets the population histogram of its own groups, and the histogram
    entries that sort strictly better are summed. Every row of ``rows`` must also be a
    row of ``population`` (its own histogram entry then guarantees it a partner), and
    ``rows`` is read once.
    """
    group = list(group)
    cols = rows.columns
    needed = F.broadcast(rows.select(*group).distinct())  # the groups of the slice only
    population = population.select(*group, value).join(needed, group, "left_semi")
    hist = population.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(value, "_v")
    pairs = hist.join(F.broadcast(rows), group)
    better = F.when(_better(F.col("_v"), F.col(value), desc), F.col("_n")).otherwise(F.lit(0))
    return pairs.groupBy(*cols).agg((F.sum(better) + 1).cast("long").alias(out))


def _falling(df: DataFrame, column: str) -> Column:
    """A key that rises where ``column`` falls: the bitwise complement of integers (it cannot
    overflow), the negative of other numbers."""
    integral = df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.bitwise_not(column) if integral else -F.col(column)


def positions(
    df: DataFrame,
    value: str,
    tiebreak: str,
    group: Sequence[str] = (),
    desc: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``row_no`` (place in the order of value and the unique ``tiebreak``), ``first_row`` and
    ``last_row`` (places of the first and last row of equal value) and ``n_rows``, all of the row's
    group, for frames of any size: no window holds more than a range of the rows.

    The rows are range-partitioned on (group, value, tiebreak) and written once with their
    segment. Windows within a segment give local places; the per-segment table (one row per
    group and segment) carries row counts across borders, and the border of the last tied value:
    a run of equal values may start some segments before and end some after. Falling orders put
    NULLs last, rising ones first. Every ranking function follows from these columns: RANK is
    first_row, ROW_NUMBER is row_no, see ``ntile_from`` and ``percent_rank_from``.
    """
    # One group of all rows where none is asked for: its constant key only heads the order.
    keys = list(group) or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    key = _falling(df, value) if desc else F.col(value)
    rows = rows.withColumn("_null", F.col(value).isNull() if desc else F.col(value).isNotNull()).withColumn("_key", key)
    r = _segments(rows, keys, ["_null", "_key", tiebreak], partitions)
    here = Window.partitionBy(*keys, "_seg").orderBy("_null", "_key")
    tied = Window.partitionBy(*keys, "_seg", "_null", "_key")
    r = r.withColumns(
        {
            "_rn": F.row_number().over(here.orderBy("_null", "_key", tiebreak)),
            "_rank": F.rank().over(here),
            "_ties": F.count(F.lit(1)).over(tied),
        }
    )
    at = F.struct("_null", "_key")
    seg = r.groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("_size"), F.min(at).alias("_low"), F.max(at).alias("_high"), F.max("_rank").alias("_top"), F.min_by("_ties", "_rank").alias("_run")
    )
    along = Window.partitionBy(*keys).orderBy("_seg")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    offset = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    seg = seg.withColumn("_offset", offset).withColumn("_fresh", ~F.coalesce(F.lag("_high").over(along) == F.col("_low"), F.lit(False)))
    begins = F.when(F.col("_top") > 1, F.col("_offset") + F.col("_top")).when(F.col("_fresh"), F.col("_offset") + 1)  # of its last run
    ends = F.when(F.col("_fresh"), F.col("_offset")).when(F.col("_run") < F.col("_size"), F.col("_offset") + F.col("_run"))  # the first end from its start on
    seg = seg.withColumn("_begins", begins).withColumn("_ends", ends)
    total = F.sum("_size").over(Window.partitionBy(*keys))
    seg = seg.select(
        *[F.col(k).alias(u) for k, u in zip(keys, _unit_names(keys), strict=True)],
        F.col("_seg").alias("_s"),
        "_size",
        "_offset",
        "_fresh",
        total.alias("n_rows"),
        F.last("_begins", ignorenulls=True).over(earlier).alias("_run_start"),
        F.coalesce(F.first("_ends", ignorenulls=True).over(later), total).alias("_run_end"),
    )
    out = r.join(seg, _same_segment(keys))
    starts_here = (F.col("_rank") > 1) | F.col("_fresh")
    local_end = F.col("_rank") + F.col("_ties") - 1
    out = out.withColumns(
        {
            "row_no": (F.col("_offset") + F.col("_rn")).cast("long"),
            "first_row": F.when(starts_here, F.col("_offset") + F.col("_rank")).otherwise(F.col("_run_start")).cast("long"),
            "last_row": F.when(local_end < F.col("_size"), F.col("_offset") + local_end).otherwise(F.col("_run_end")).cast("long"),
        }
    )
    inner = ["_all", "_null", "_key", "_seg", "_s", "_rn", "_rank", "_ties", "_size", "_offset", "_fresh", "_run_start", "_run_end"]
    return out.drop(*inner, *_unit_names(keys))


def ntile_from(n: int, row_no: str = "row_no", n_rows: str = "n_rows") -> Column:
    """NTILE(n) from a row's place and the number of rows: the first (rows mod n) tiles hold one
    row more than the others."""
    row, rows = F.col(row_no) - 1, F.col(n_rows)
    short = F.floor(rows / n)
    longer = (rows % n) * (short + 1)  # rows in the longer tiles
    # Spark evaluates the second branch only beyond them, where the short tiles have rows.
    tile = F.when(row < longer, F.floor(row / (short + 1))).otherwise(rows % n + F.floor((row - longer) / F.greatest(short, F.lit(1))))
    return (tile + 1).cast("long")


def percent_rank_from(reverse: bool = False, n_rows: str = "n_rows") -> Column:
    """PERCENT_RANK in [0, 1] from ``positions``; with ``reverse`` that of the opposite order."""
    before = F.col(n_rows) - F.col("last_row") if reverse else F.col("first_row") - 1
    return F.when(F.col(n_rows) > 1, before / (F.col(n_rows) - 1)).otherwise(F.lit(0.0))


def top_n_per(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """ROW_NUMBER() top-n per group. ``order`` must end in a unique tie-break. Catalyst
    plans a partial WindowGroupLimit before the shuffle, so each map task sends at most
    n rows per group: a hot group costs n x tasks rows, not its size."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))


def global_rank(order: Sequence[Column]) -> Column:
    """RANK() OVER (ORDER BY ...) for a frame bounded by a dimension (e.g. provinces)."""
    return F.rank().over(Window.orderBy(*order)).cast("long")


def ntile_of(n: int, order: Sequence[Column]) -> Column:
    """NTILE(n) OVER (ORDER BY ...); give a unique tie-break in ``order``."""
    return F.ntile(n).over(Window.orderBy(*order)).cast("long")


def pct_rank_of(order: Sequence[Column]) -> Column:
    """PERCENT_RANK() OVER (ORDER BY ...) as a double in [0, 1]."""
    return F.percent_rank().over(Window.orderBy(*order))


def composite_rank(df: DataFrame, metrics: dict[str, Column], total: str = "composite_rank_sum") -> DataFrame:
    """One RANK() column per metric (name -> ordering) plus their sum. Applied to
    aggregated frames bounded by a dimension."""
    out = df
    for name, order in metrics.items():
        out = out.withColumn(name, global_rank([order]))
    sum_expr = None
    for name in metrics:
        sum_expr = F.col(name) if sum_expr is None else sum_expr + F.col(name)
    return out.withColumn(total, sum_expr)
