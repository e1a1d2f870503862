"""Longitudinal operators over a (unit x period) panel.

Windows here are partitioned by the unit (a settlement has at most one row per round),
so every window group is bounded by the number of rounds. Period-to-period comparison
is one scan plus one aggregation by unit instead of a self-join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.expr import round_half_up, safe_div
from panelscope.sources.tables import shared_dir

ROWS_PER_SEGMENT = 1_000_000  # of a segmented scan


def _w(unit: str | None, period: str, tiebreak: str | None = None) -> Window:
    order = [period, tiebreak] if tiebreak else [period]
    return (Window.partitionBy(unit) if unit else Window.partitionBy()).orderBy(*order)


def period_delta(
    df: DataFrame,
    measure: str,
    period: str,
    unit: str | None = None,
    prev: str = "prev",
    delta: str | None = None,
    pct: str | None = None,
    pct_digits: int = 2,
    direction: str = "lag",
    tiebreak: str | None = None,
    segmented: bool = False,
) -> DataFrame:
    """Previous (``lag``) or next (``lead``) value of ``measure`` per unit along the
    period order, with optional absolute and percent change (NULL when previous is 0).
    Without ``unit`` the window is global: use it only on frames aggregated per period. With
    ``segmented`` by ``unit_scan``, for data where one unit may be hot (``tiebreak`` must then
    be a unique column)."""
    if segmented:
        out = unit_scan(df, unit, [period, tiebreak], measure, **{"prev" if direction == "lag" else "next": prev})
    else:
        w = _w(unit, period, tiebreak)
        out = df.withColumn(prev, F.lag(measure).over(w) if direction == "lag" else F.lead(measure).over(w))
    if delta:
        out = out.withColumn(delta, F.col(measure) - F.col(prev))
    if pct:
        out = out.withColumn(
            pct,
            round_half_up(safe_div((F.col(measure) - F.col(prev)).cast("double") * F.lit(100.0), F.col(prev)), pct_digits),
        )
    return out


def running_total(df: DataFrame, unit: str, period: str, measure: str, out: str, tiebreak: str | None = None) -> DataFrame:
    """SUM(measure) OVER (PARTITION BY unit ORDER BY period ROWS UNBOUNDED PRECEDING)."""
    w = _w(unit, period, tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(measure).over(w))


def moving_avg(
    df: DataFrame,
    unit: str,
    period: str,
    measure: str,
    n: int,
    out: str,
    digits: int | None = None,
    tiebreak: str | None = None,
    segmented: bool = False,
) -> DataFrame:
    """AVG over the current and n-1 preceding rows per unit (the frame shrinks at the
    start; NULLs don't count, a frame of NULLs alone has none); rounded when ``digits`` is given.
    With ``segmented`` by ``unit_frame``, for data where one unit may be hot (``tiebreak`` must
    then be a unique column)."""
    if segmented:
        framed = unit_frame(df, unit, [period, tiebreak], measure, {out: F.avg}, n - 1)
    else:
        framed = df.withColumn(out, F.avg(measure).over(_w(unit, period, tiebreak).rowsBetween(-(n - 1), Window.currentRow)))
    return framed.withColumn(out, round_half_up(F.col(out), digits)) if digits is not None else framed


def period_compare(
    df: DataFrame, unit: str, period: str, a: int, b: int, measures: dict[str, str]
) -> DataFrame:
    """One row per unit with ``measure`` at period ``a`` and at period ``b``.

    ``measures`` maps a measure to an output prefix; columns are ``{prefix}_a`` and
    ``{prefix}_b`` (e.g. idp -> idp_a, idp_b). Relies on (unit, period) being unique, as
    the panel declares, so MAX over the single matching row is that row's value. Only
    rows of the two periods are read (partition pruning on the period column); units present
    in just one of them are left out (the inner join of the two periods).
    """
    sel = df.where(F.col(period).isin(a, b))
    aggs = []
    for m, p in measures.items():
        aggs.append(F.max(F.when(F.col(period) == a, F.col(m))).alias(f"{p}_a"))
        aggs.append(F.max(F.when(F.col(period) == b, F.col(m))).alias(f"{p}_b"))
    aggs.append(F.count(F.when(F.col(period) == a, 1)).alias("_has_a"))
    aggs.append(F.count(F.when(F.col(period) == b, 1)).alias("_has_b"))
    return (
        sel.groupBy(unit)
        .agg(*aggs)
        .where((F.col("_has_a") > 0) & (F.col("_has_b") > 0))
        .drop("_has_a", "_has_b")
    )


def surges(
    df: DataFrame,
    unit: str,
    period: str,
    measure: str,
    factor: float = 1.5,
    prev: str = "prev",
    tiebreak: str | None = None,
    segmented: bool = False,
) -> DataFrame:
    """Rows whose measure exceeds ``factor`` x the unit's previous value (previous > 0).
    The lag is taken over all rows before filtering, in (period, ``tiebreak``) order; with
    ``segmented`` by ``unit_scan``, for data where one unit may be hot (``tiebreak`` must then
    be a unique column)."""
    if segmented:
        lagged = unit_scan(df, unit, [period, tiebreak], measure, prev=prev)
    else:
        lagged = period_delta(df, measure, period, unit=unit, prev=prev, tiebreak=tiebreak)
    return lagged.where((F.col(prev) > 0) & (F.col(measure) > F.col(prev) * F.lit(float(factor))))


def top_units(df: DataFrame, unit: str, score: Column, k: int, tiebreak: Sequence[Column] | None = None) -> DataFrame:
    """The k units with the highest ``score`` (an aggregate), ties broken by unit id.
    Spark plans TakeOrderedAndProject: each task keeps its own top k."""
    agg = df.groupBy(unit).agg(score.alias("_score"))
    order = [F.col("_score").desc_nulls_last(), *(tiebreak or [F.col(unit).asc()])]
    return agg.orderBy(*order).limit(k)


def top_trajectories(df: DataFrame, unit: str, score: Column, k: int, score_name: str = "score") -> DataFrame:
    """All rows of the k units with the highest ``score`` (an aggregate over the unit's
    rows, ties broken by unit id), with the score attached. The k-row set is bounded, so
    it is the broadcast side of the join back to the rows."""
    top = top_units(df, unit, score, k).select(unit, F.col("_score").alias(score_name))
    return df.join(F.broadcast(top), unit)


def _segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned on (keys, order) with its range as ``_seg``, written once into the
    shared checkpoint folder, so that everything that reads it sees the same segments."""
    spark = df.sparkSession
    shared_dir(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_SEGMENT))
    return df.repartitionByRange(n, *keys, *order).withColumn("_seg", F.spark_partition_id()).checkpoint()


def _same_segment(keys: Sequence[str]) -> Column:
    """Rows (keys, _seg) meet the segment table's (_u0.., _s); null keys are a unit like any other."""
    same = F.col("_seg") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_u{i}"))
    return same


def _unit_names(keys: Sequence[str]) -> list[str]:
    return [f"_u{i}" for i in range(len(keys))]


def unit_scan(
    df: DataFrame,
    unit: str | Sequence[str],
    order: Sequence[str],
    value: str,
    prev: str | None = None,
    cum: str | None = None,
    partitions: int | None = None,
    next: str | None = None,
) -> DataFrame:
    """LAG(value), LEAD(value) and the running SUM(value) per unit along ``order`` without
    putting a unit's rows into one task, for data where one unit may hold a large share of the
    rows.

    ``order`` must end in a unique tie-break. The rows are range-partitioned on
    (unit, *order), which splits a hot unit over many tasks, and written once with their
    segment (the range) into the shared checkpoint folder, so that everything below reads
    the same segments. The windows then run per (unit, segment), and a window over the small
    per-segment table (one row per segment) carries the last value and the running total of the
    segments before, and the first value of the next one that has rows of the unit, across
    segment borders. Equal to the plain window (``period_delta`` / ``running_total``) with the
    same ordering; all columns of ``df`` are kept.
    """
    order = list(order)
    keys = [unit] if isinstance(unit, str) else list(unit)
    r = _segments(df, keys, order, partitions)
    w = Window.partitionBy(*keys, "_seg").orderBy(*order)
    place = F.struct(*order)
    seg = r.groupBy(*keys, "_seg").agg(
        F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"), F.sum(value).alias("_tot")
    )
    ws = Window.partitionBy(*keys).orderBy("_seg")
    seg = seg.select(
        *[F.col(k).alias(u) for k, u in zip(keys, _unit_names(keys), strict=True)],
        F.col("_seg").alias("_s"),
        F.lag("_last").over(ws).alias("_prev_last"),
        F.lead("_first").over(ws).alias("_next_first"),
        F.sum("_tot").over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"),
    )
    r = r.withColumn("_rn", F.row_number().over(w))
    if prev:
        r = r.withColumn("_lag", F.lag(value).over(w))
    if next:
        r = r.withColumn("_lead", F.lead(value).over(w)).withColumn("_ends", F.lead(F.lit(1)).over(w).isNull())
    if cum:
        r = r.withColumn("_cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = r.join(seg, _same_segment(keys))
    if prev:
        out = out.withColumn(prev, F.when(F.col("_rn") == 1, F.col("_prev_last")).otherwise(F.col("_lag")))
    if next:
        out = out.withColumn(next, F.when(F.col("_ends"), F.col("_next_first")).otherwise(F.col("_lead")))
    if cum:
        both_null = F.col("_cum").isNull() & F.col("_offset").isNull()
        out = out.withColumn(
            cum, F.when(~both_null, F.coalesce(F.col("_cum"), F.lit(0)) + F.coalesce(F.col("_offset"), F.lit(0)))
        )
    inner = ["_seg", "_s", "_rn", "_lag", "_lead", "_ends", "_cum", "_prev_last", "_next_first", "_offset"]
    return out.drop(*inner, *_unit_names(keys))


def unit_frame(
    df: DataFrame,
    unit: str | Sequence[str],
    order: Sequence[str],
    value: str,
    aggregates: dict[str, Callable[[Column], Column]],
    preceding: int,
    following: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Aggregates of ``value`` over ROWS BETWEEN preceding AND following per unit, for data where
    one unit may hold a large share of the rows (a halo exchange).

    ``order`` must end in a unique tie-break; ``aggregates`` maps an output name to a function of
    the value, as F.avg. The rows are split into segments as in ``unit_scan``. A segment's frames
    reach at most ``preceding`` rows back and ``following`` ahead of it; those rows, by their
    position in the unit, are the halo. They lie at the borders of the segments next to it, or
    of several where one is shorter than the frame, so only border rows are sent, each by a join
    on (unit, position), and the window then runs per (unit, segment) over its rows and its halo.
    """
    order = list(order)
    keys = [unit] if isinstance(unit, str) else list(unit)
    names = _unit_names(keys)
    r = _segments(df, keys, order, partitions)
    sizes = r.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = sizes.select(
        *[F.col(k).alias(u) for k, u in zip(keys, names, strict=True)],
        F.col("_seg").alias("_s"),
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    numbered = r.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)))
    placed = numbered.join(seg, _same_segment(keys)).withColumn("_pos", F.col("_offset") + F.col("_rn"))
    border = (F.col("_rn") <= following) | (F.col("_rn") > F.col("_size") - preceding)
    edges = placed.where(border).select(*[F.col(u).alias(f"_e{i}") for i, u in enumerate(names)], F.col("_pos").alias("_at"), F.col(value).alias("_edge"))
    start, end = F.col("_offset"), F.col("_offset") + F.col("_size")
    reach = [F.sequence(start - preceding + 1, start)] if preceding else []
    reach += [F.sequence(end + 1, end + following)] if following else []
    if reach:
        needed = seg.select(*names, "_s", F.explode(F.concat(*reach)).alias("_pos")).where("_pos > 0")
        same = F.col("_pos") == F.col("_at")
        for i, u in enumerate(names):
            same = same & F.col(u).eqNullSafe(F.col(f"_e{i}"))
        halo = needed.join(edges, same).select(*[F.col(u).alias(k) for k, u in zip(keys, names, strict=True)], F.col("_s").alias("_seg"), "_pos", F.col("_edge").alias("_value"))
    own = placed.withColumn("_own", F.lit(True)).withColumn("_value", F.col(value)).drop("_rn", "_s", "_size", "_offset", *names)
    every = own.unionByName(halo, allowMissingColumns=True) if reach else own
    w = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(-preceding, following)
    found = every.withColumns({name: of(F.col("_value")).over(w) for name, of in aggregates.items()})
    return found.where("_own").drop("_seg", "_pos", "_own", "_value")
