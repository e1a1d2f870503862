"""Rows that a load turns away, each with the name of the rule it breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.sources.tables import broadcast_if_small, shared_dir


def split_repeats(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first, surplus): of the rows that share ``keys`` (not null) the smallest by the other
    columns in their order stays, every other one is surplus, copies of the smallest included.

    Keys are counted first, map-side; rows whose key is alone pass through without a shuffle of
    their own (the repeated keys are broadcast when they are few). Of the others equal rows are
    counted, so a group of copies of any size is a row with a number, and the smallest row of a key
    is a partial aggregate: no task holds a key's rows. ``rows`` is read four times.
    """
    keys, columns = list(keys), rows.columns
    shared_dir(rows.sparkSession)
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).checkpoint()
    repeated = broadcast_if_small(repeated)
    alone = rows.join(repeated, keys, "left_anti").select(*columns)
    first, surplus = split_copies(rows.join(repeated, keys, "left_semi").select(*columns), keys)
    return alone.unionByName(first), surplus


def split_copies(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``split_repeats`` of rows whose keys are known to be repeated; ``rows`` is read once."""
    keys, columns = list(keys), rows.columns
    shared_dir(rows.sparkSession)
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    rest = F.struct(*[c for c in columns if c not in keys], F.lit(0))
    least = counted.groupBy(*keys).agg(F.min(rest).alias("_least"))
    marked = counted.join(least, keys).withColumn("_first", rest == F.col("_least")).checkpoint()
    first = marked.where("_first").select(*columns)
    spare = F.col("_n") - F.col("_first").cast("long")
    surplus = marked.where(spare > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), spare)).alias("_copy")).drop("_copy")
    return first, surplus
