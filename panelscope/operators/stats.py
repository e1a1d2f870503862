"""Order statistics without a global sort: of a column (``kth_value``), and of every group at once
(``kth_in``).

``kth_value`` returns the value at 0-based position k of a column ordered ascending with NULLs
first (the positional median is k = COUNT(*) div 2). It is exact whatever the distribution:

1. one aggregate gives the counts, the minimum and the maximum;
2. the value range is cut into ``buckets`` equal-width blocks, rows are counted per block
   (map-side partial aggregation, with each block's own minimum and maximum), and the block
   that holds position k becomes the next range;
3. this is repeated until that block holds a single value. A range shrinks at least
   ``buckets``-fold per step and to the values that are there, so integers of 64 bits need at
   most 7 steps, and an outlier costs one step.

No window and no sort over rows: at most ``buckets`` counts per step reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators.panel import unit_scan
from panelscope.sources.tables import broadcast_if_small


def kth_value(
    df: DataFrame, col: str, k: DataFrame | int | None = None, out: str = "value", buckets: int = 1024
) -> DataFrame:
    """One-row frame with column ``out``: the value at 0-based position ``k`` of ``col`` sorted
    ascending with NULLs first; ``k`` is a number or a one-row, one-column frame, by default
    ``COUNT(*) div 2`` of ``df``. NULL when k lands on a NULL or past the end."""
    v = F.col(col)
    rows, known, lo, hi = df.agg(F.count(F.lit(1)), F.count(v), F.min(v), F.max(v)).first()
    at = rows // 2 if k is None else (k if isinstance(k, int) else k.first()[0])
    kind = df.schema[col].dataType
    value = None
    if at is not None and rows - known <= at < rows:
        at -= rows - known
        while lo != hi:
            at, lo, hi = _narrowed(df, col, at, lo, hi, buckets)
        value = lo
    return df.sparkSession.range(1).select(F.lit(value).cast(kind).alias(out))


def _narrowed(df: DataFrame, col: str, at: int, lo, hi, buckets: int):
    """(position, minimum, maximum) within the block of [lo, hi] that holds position ``at``."""
    v = F.col(col)
    share = (v.cast("double") - F.lit(float(lo))) / F.lit((float(hi) - float(lo)) or 1.0)
    # the ends have blocks of their own, so a step always shrinks the range
    block = F.when(v <= F.lit(lo), -1).when(v >= F.lit(hi), buckets).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    counts = (
        df.where(v.between(F.lit(lo), F.lit(hi)))
        .groupBy(block.cast("int").alias("block"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        .collect()  # at most buckets + 2 rows
    )
    for r in sorted(counts, key=lambda r: r["block"]):
        if at < r["n"]:
            return at, r["lo"], r["hi"]
        at -= r["n"]
    raise AssertionError("position past the end")


def _meets(left: Sequence[str], right: Sequence[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def kth_in(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    at: Column | None = None,
    out: str = "value",
    blocks: int = 1024,
    partitions: int | None = None,
) -> DataFrame:
    """One row per group: the group's columns and ``out``, the value at 0-based position ``at`` of
    ``value`` sorted ascending with NULLs first in the group. ``at`` is an expression of the
    group's row count ``n_rows``, by default ``n_rows div 2``, the positional median. NULL when the
    position holds a NULL or lies outside the group. Null group keys are a group like any other.

    All groups are narrowed together, and positions stay in DataFrames:

    1. one aggregation gives each group's counts, minimum and maximum;
    2. the group's range is cut into ``blocks`` equal parts; rows are counted per (group, block),
       map-side first, and the block that holds the position is found by a running count over at
       most ``blocks`` rows a group;
    3. the rows within that block are counted by value, and the value is read off the running count
       of the distinct ones, a segmented scan (``unit_scan``).

    Rows of a group never meet in one task: 1 to 3 aggregate them before any shuffle, and where
    outliers press a hot group's values into one block, the scan splits its distinct values. The
    input is read three times, a column and the keys only.
    """
    group = list(group)
    names = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col(value).alias("_v"))
    position = (F.floor(F.col("n_rows") / 2) if at is None else at).cast("long")
    bounds = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"), F.count("_v").alias("_known"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    held = F.col("_at").between(0, F.col("_known") - 1)
    bounds = bounds.withColumn("_at", position - (F.col("n_rows") - F.col("_known"))).select("*", held.alias("_held")).checkpoint()
    of_group = broadcast_if_small(bounds.where("_held").select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)], "_lo", "_hi", "_at"))
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    share = (F.col("_v").cast("double") - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    block = F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("int")
    in_blocks = rows.where("_v IS NOT NULL").join(of_group, _meets(names, [f"_b{i}" for i in range(len(names))])).select(*names, "_v", "_at", block.alias("_block"))
    counts = in_blocks.groupBy(*names, "_block", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_block"))
    hit = counts.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    within = hit.select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)], "_from", "_to", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_rest")).checkpoint()
    near = rows.join(broadcast_if_small(within), _meets(names, [f"_b{i}" for i in range(len(names))]) & F.col("_v").between(F.col("_from"), F.col("_to")))
    values = near.groupBy(*names, "_v", "_rest").agg(F.count(F.lit(1)).alias("_n"))
    scanned = unit_scan(values, names, ["_v"], "_n", cum="_upto", partitions=partitions)
    found = scanned.where((F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col("_n")))
    picked = found.select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)], F.col("_v").alias(out))
    all_groups = bounds.join(picked, _meets(names, [f"_b{i}" for i in range(len(names))]), "left")
    return all_groups.select(*[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], out)
