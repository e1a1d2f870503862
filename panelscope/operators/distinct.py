"""Exact distinct counts that merge: bitmaps of unit ids kept per group.

A unit id has a bucket (32,768 ids each) and a bit in the bucket's bitmap of 4 KB.
``unit_bitmaps`` aggregates a group's ids into such bitmaps, map-side first; the bitmaps of groups
are merged by OR, so one table of them answers COUNT(DISTINCT unit) for every coarser grouping
(province and round, province, round, all) without another pass over the rows and without a
shuffle of (group, unit) pairs. Bitmaps suit ids without large holes, as the surrogate keys are: a
group costs 4 KB per bucket that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_bitmaps(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """One row per group of ``keys`` and bucket of ids: keys, bucket, bits. NULL ids are in none,
    as COUNT(DISTINCT) counts none."""
    ids = df.where(F.col(unit).isNotNull()).select(
        *keys, F.bitmap_bucket_number(unit).alias("bucket"), F.bitmap_bit_position(unit).alias("_bit")
    )
    return ids.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups: ``keys`` are some of those the bitmaps have."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_units(bitmaps: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """COUNT(DISTINCT unit) per group of ``keys`` as ``out``, from bitmaps of the same or finer groups."""
    counts = merged_bitmaps(bitmaps, keys).select(*keys, F.bitmap_count("bits").alias("_n"))
    return counts.groupBy(*keys).agg(F.sum("_n").alias(out))
