"""Space-filling order and bounding boxes by grid cells.

``z_order`` interleaves the bits of several ranks, so rows that are near in every one of them lie
near in one sort order, and Parquet's minima and maxima skip by each. ``grid_cell`` is the z-order of
a coordinate's place in a grid of 2^GRID_BITS by 2^GRID_BITS cells over the globe; a bounding box is
then a few ranges of cell numbers (``cell_ranges``), which the scan receives as pushed filters, and
an exact comparison of the coordinates at its edges (``in_box``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_BITS = 15  # a cell is 360 / 2^15 degrees wide and half as high
MAX_RANGES = 32  # of cells that a box is turned into


def z_order(ranks: Sequence[tuple[Column, int]]) -> Column:
    """Interleaved bits of ``(rank, bits)`` as a long, the highest bits of all ranks first, so a
    rank of few bits divides the order as early as one of many. Ranks are integers from 0 below
    2^bits; together they have at most 63 bits. NULL when any rank is."""
    left = sum(bits for _, bits in ranks)
    if left > 63:
        raise ValueError("more than 63 bits")
    out = None
    for level in range(max(bits for _, bits in ranks)):
        for rank, bits in ranks:
            if level < bits:
                left -= 1
                one = F.shiftleft(F.shiftright(rank.cast("long"), bits - 1 - level).bitwiseAND(F.lit(1)), left)
                out = one if out is None else out.bitwiseOR(one)
    return out


def _cell_axis(degrees: Column, low: float, width: float) -> Column:
    side = 1 << GRID_BITS
    at = F.floor((degrees - F.lit(low)) / F.lit(width) * F.lit(float(side)))
    return F.greatest(F.lit(0), F.least(at, F.lit(side - 1)))


def grid_cell(latitude: Column, longitude: Column) -> Column:
    """The number of the cell that holds a coordinate; those outside the globe belong to the cells
    at its edge, a missing one to none."""
    known = latitude.isNotNull() & longitude.isNotNull()
    return F.when(known, z_order([(_cell_axis(latitude, -90.0, 180.0), GRID_BITS), (_cell_axis(longitude, -180.0, 360.0), GRID_BITS)]))


@dataclass(frozen=True)
class Box:
    """Degrees; open bounds are None. A west bound east of the east bound crosses the date line.
    ``strict`` leaves out coordinates on a bound."""

    south: float | None = None
    north: float | None = None
    west: float | None = None
    east: float | None = None
    strict: bool = True

    @property
    def crosses(self) -> bool:
        return self.west is not None and self.east is not None and self.west > self.east


def in_box(box: Box, latitude: Column, longitude: Column) -> Column:
    """The exact test; missing coordinates never pass, whatever bounds there are."""
    above = (lambda c, v: c > v) if box.strict else (lambda c, v: c >= v)
    below = (lambda c, v: c < v) if box.strict else (lambda c, v: c <= v)
    passes = latitude.isNotNull() & longitude.isNotNull()
    if box.south is not None:
        passes = passes & above(latitude, box.south)
    if box.north is not None:
        passes = passes & below(latitude, box.north)
    if box.crosses:
        return passes & (above(longitude, box.west) | below(longitude, box.east))
    if box.west is not None:
        passes = passes & above(longitude, box.west)
    if box.east is not None:
        passes = passes & below(longitude, box.east)
    return passes


def _axis_range(low: float | None, high: float | None, start: float, width: float) -> tuple[int, int]:
    side = 1 << GRID_BITS
    at = lambda v: max(0, min(side - 1, int((v - start) / width * side // 1)))
    return (0 if low is None else at(low), side - 1 if high is None else at(high))


def cell_ranges(box: Box, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most about ``most`` ranges of cell numbers, ends included, that cover the box: the grid's
    quadrants are split, largest first, as long as they lie across its edge and the number allows."""
    rows = _axis_range(box.south, box.north, -90.0, 180.0)
    if box.crosses:
        spans = [_axis_range(box.west, None, -180.0, 360.0), _axis_range(None, box.east, -180.0, 360.0)]
    else:
        spans = [_axis_range(box.west, box.east, -180.0, 360.0)]
    targets = [(rows, columns) for columns in spans if rows[0] <= rows[1] and columns[0] <= columns[1]]

    def meets(low_row, low_column, side) -> int:
        """0: apart from the box, 1: across its edge, 2: inside."""
        found = 0
        for (r0, r1), (c0, c1) in targets:
            if low_row > r1 or low_row + side - 1 < r0 or low_column > c1 or low_column + side - 1 < c0:
                continue
            whole = r0 <= low_row and low_row + side - 1 <= r1 and c0 <= low_column and low_column + side - 1 <= c1
            found = max(found, 2 if whole else 1)
        return found

    side = 1 << GRID_BITS
    open_quads = [(0, 0, 0)] if meets(0, 0, side) else []  # first cell, row, column
    closed: list[tuple[int, int]] = []
    while open_quads and side > 1 and len(closed) + len(open_quads) < most:
        half, following = side // 2, []
        for first, row, column in open_quads:
            if meets(row, column, side) == 2:
                closed.append((first, first + side * side - 1))
                continue
            for quarter in range(4):  # in z-order: rows are the higher bits
                at = (first + quarter * half * half, row + half * (quarter >> 1), column + half * (quarter & 1))
                if meets(at[1], at[2], half):
                    following.append(at)
        side, open_quads = half, following
    closed += [(first, first + side * side - 1) for first, _, _ in open_quads]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(closed):
        if merged and merged[-1][1] + 1 >= low:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def box_filter(df: DataFrame, box: Box, latitude: str = "latitude", longitude: str = "longitude", cell: str = "cell") -> DataFrame:
    """Rows within the box. A frame with ``grid_cell`` numbers in ``cell`` (see
    ``sources.clustering``) is first narrowed by ranges of them, which reach the scan."""
    exact = in_box(box, F.col(latitude), F.col(longitude))
    if cell not in df.columns:
        return df.where(exact)
    near = F.lit(False)
    for low, high in cell_ranges(box):
        near = near | F.col(cell).between(low, high)
    return df.where(near).where(exact)
