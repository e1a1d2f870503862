"""Layouts that let a scan skip by several columns at once.

``write_clustered`` lays the fact out in z-order of its round and its settlement's place in the
hierarchy (province, district, settlement in that order), with the ids of province and district as
columns: a filter on any of round, province, district or settlement, or on a round together with a
place, meets few row groups. ``write_gridded`` lays settlements out by the grid cells of their
coordinates, for bounding boxes. Both are range-partitioned by the sort key, so no range of equal
places holds more than its share of the rows, and are read as plain Parquet.

Rounds and provinces are skipped by a row group's minimum and maximum. District and settlement ids
needn't rise with the hierarchy's order, so these columns have Bloom filters as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.operators.geo import with_geo
from panelscope.operators.rank import positions
from panelscope.operators.space import grid_cell, z_order
from panelscope.sources.tables import ROWS_PER_FILE, Tables, broadcast_if_small

PLACE_BITS = 12  # places are cut into 2^12 equal parts of the hierarchy's order
ROW_GROUP_BYTES = 16 * 1024 * 1024


def _written(df: DataFrame, key: str, path: str, partitions: int | None, row_group_bytes: int, bloom: tuple[str, ...] = ()) -> None:
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_FILE))
    laid = df.repartitionByRange(n, key).sortWithinPartitions(key)
    writer = laid.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)


def hierarchy_places(t: Tables) -> DataFrame:
    """settlement_id, district_id, province_id and ``part``, the settlement's place in the order of
    province, district and settlement, cut into 2^PLACE_BITS equal parts."""
    keys = t.hierarchy()
    districts = keys.select("province_id", "district_id").distinct()
    numbered = positions(districts, "province_id", "district_id", desc=False).select(
        "province_id", "district_id", F.col("row_no").alias("_district_no")
    )
    placed = positions(keys.join(broadcast_if_small(numbered), ["province_id", "district_id"]), "_district_no", "settlement_id", desc=False)
    part = F.floor((F.col("row_no") - 1) * (1 << PLACE_BITS) / F.col("n_rows")).cast("int")
    return placed.select("settlement_id", "district_id", "province_id", part.alias("part"))


def write_clustered(t: Tables, path: str, partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """The observations with district_id and province_id in z-order of round and place. Rows
    without a place or a round have no key and come first."""
    rounds = t.small("survey_rounds").select("round_id").distinct()
    numbered = positions(rounds, "round_id", "round_id", desc=False).select("round_id", (F.col("row_no") - 1).alias("_round"), "n_rows")
    bits = max(1, ((numbered.agg(F.max("n_rows")).first()[0] or 1) - 1).bit_length())
    places = hierarchy_places(t).select("settlement_id", "part")
    rows = with_geo(t.observations, t, how="left").join(broadcast_if_small(numbered.drop("n_rows")), "round_id", "left")
    rows = rows.join(broadcast_if_small(places), "settlement_id", "left")
    keyed = rows.withColumn("z", z_order([(F.col("_round"), bits), (F.col("part"), PLACE_BITS)])).drop("_round", "part")
    _written(keyed, "z", path, partitions, row_group_bytes, ("district_id", "settlement_id"))


def write_gridded(settlements: DataFrame, path: str, partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """The settlements with their grid ``cell``, in its order; those without coordinates come first."""
    keyed = settlements.withColumn("cell", grid_cell(F.col("latitude"), F.col("longitude")))
    _written(keyed, "cell", path, partitions, row_group_bytes)
