"""Approximate nearest neighbours by cosine: stable projections, indexed by kd-trees, searched
until a chi-square test says that no nearer vector is likely to be left.

Vectors of length one are projected by DIMS Gaussian (2-stable) directions. A pair's squared
distance in the projection, over its true squared distance, is chi-square distributed with
DIMS degrees of freedom. The projected points are taken in the order of their distance r to the
query and verified exactly; with d the true distance of the k-th best so far, the search stops
when the chi-square distribution at r^2 / d^2 reaches CERTAINTY: a nearer vector would have
come up before with that probability.

The index is a kd-tree in two parts. Its top, fitted on a bounded sample (SAMPLE vectors), deals
all vectors out to cells; each cell's tree is built in the task that searches it. A query first
searches its own cell and takes from there its k-th distance; then it is sent to those cells
only whose region the stopping test does not rule out. A cell with more than BLOCK queries of its
own is searched in several tasks, so a cell is sent as often as its own queries ask for.

Vectors that are equal component by component are searched as one: of each group only the k + 1
smallest ids can be in a result, and are kept, by a limit that each task applies before the
shuffle.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null id, take no part; rows that repeat id and vector count once; a query whose id has
several vectors uses the smallest; vectors of another length are never compared; a query with
fewer candidates than k returns them all; components of any finite size are compared without
overflow (vectors are scaled by powers of two); an empty table has no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.llm.common import BROADCAST_BYTES, blocks_for, kept

DIMS = 8  # even: the chi-square distribution then has a closed form
CERTAINTY = 0.98
SAMPLE = 20_000
CELL = 8192  # vectors per cell
LEAF = 512
BLOCK = 4096  # queries per task


def chi_square(x: float) -> float:
    """Distribution function of the chi-square distribution with DIMS degrees of freedom."""
    if x <= 0:
        return 0.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, DIMS // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def _stop_ratio() -> float:
    """The least r^2 / d^2 at which the test holds."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square(mid) >= CERTAINTY else (mid, hi)
    return hi


STOP = _stop_ratio()


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector over the power of two next to its largest component: its cosines stay what they
    are to the last bit, and squares neither overflow nor vanish."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponents[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def project(units: np.ndarray) -> np.ndarray:
    return units @ np.random.default_rng(units.shape[1]).normal(size=(units.shape[1], DIMS))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


class Split:
    """The top of the kd-tree of one vector length: cells numbered from ``first``."""

    def __init__(self, points: np.ndarray, cells: int, first: int):
        self.first, self.cells = first, []
        lo, hi = np.full(DIMS, -np.inf), np.full(DIMS, np.inf)
        self.root = self._cut(points, cells, lo, hi)
        self.lo, self.hi = np.array([c[0] for c in self.cells]), np.array([c[1] for c in self.cells])

    def _cut(self, points, cells, lo, hi):
        if cells > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            at = float(np.quantile(points[:, axis], (cells // 2) / cells))
            left = points[:, axis] <= at
            if left.any() and not left.all():
                lo2, hi2 = lo.copy(), hi.copy()
                hi2[axis], lo2[axis] = at, at
                return axis, at, self._cut(points[left], cells // 2, lo, hi2), self._cut(points[~left], cells - cells // 2, lo2, hi)
        self.cells.append((lo, hi))
        return self.first + len(self.cells) - 1

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)

        def go(node, rows):
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                axis, at, left, right = node
                below = points[rows, axis] <= at
                go(left, rows[below])
                go(right, rows[~below])

        go(self.root, np.arange(len(points)))
        return out

    def open_cells(self, point: np.ndarray, reach: float, home: int) -> list[int]:
        """Cells other than ``home`` whose region lies nearer than ``reach`` (squared)."""
        gap = np.maximum(np.maximum(self.lo - point, point - self.hi), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach) + self.first
        return [int(c) for c in near if c != home]


class Tree:
    """A kd-tree over the projected points of a cell; leaves hold ranges of ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points))

    def _build(self, a: int, b: int):
        rows = self.points[self.order[a:b]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        axis = int(np.argmax(hi - lo))
        if b - a <= LEAF or hi[axis] == lo[axis]:
            return lo, hi, a, b, None
        mid = (b - a) // 2
        part = np.argpartition(rows[:, axis], mid)
        self.order[a:b] = self.order[a:b][part]
        return lo, hi, a, b, (self._build(a, a + mid), self._build(a + mid, b))

    def nearest(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves in the order of their least squared distance."""
        heap = [(0.0, 0, self.root)]
        n = 1
        while heap:
            r, _, node = heapq.heappop(heap)
            if node[4] is None:
                yield r, self.order[node[2] : node[3]]
                continue
            for child in node[4]:
                gap = np.maximum(np.maximum(child[0] - point, point - child[1]), 0)
                heapq.heappush(heap, (float(gap @ gap), n, child))
                n += 1


def _distance(score: float) -> float:
    """Squared distance of two vectors of length one with the cosine ``score``."""
    return max(0.0, 2.0 - 2.0 * score)


def search_cell(ids: np.ndarray, vectors: np.ndarray, queries: pd.DataFrame, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's best in one cell."""
    vectors = scaled(vectors)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    tree = Tree(project(vectors / norms[:, None]))
    asked = scaled(_stack(queries["vec"]))
    points = project(unit(asked))
    lengths = np.sqrt((asked * asked).sum(axis=1))
    out = []
    for i, (own, bound) in enumerate(zip(queries["id"].to_numpy(), queries["bound"].to_numpy(), strict=True)):
        best: list[tuple[float, int]] = []  # minus score, id
        for r, rows in tree.nearest(points[i]):
            limit = _distance(bound)
            if len(best) == k:
                limit = min(limit, _distance(-best[-1][0]))
            if r > 0 and r >= STOP * limit:
                break
            scores = (vectors[rows] * asked[i]).sum(axis=1) / (norms[rows] * lengths[i])
            if len(best) == k:
                better = scores >= -best[-1][0]
                scores, rows = scores[better], rows[better]
            if len(rows):
                near = [(-s, v) for s, v in zip(scores.tolist(), ids[rows].tolist(), strict=True) if v != own]
                best = heapq.nsmallest(k, best + near)
        out += [(int(own), v, -s) for s, v in best]
    return out


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).distinct()


def dealt(cells: DataFrame, queries: DataFrame, few_cells: bool) -> tuple[DataFrame, DataFrame]:
    """The vectors of cells that have queries, once per BLOCK of the cell's own queries, and the
    queries in those blocks."""
    sizes = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("cell", "of")
    sizes = F.broadcast(sizes) if few_cells else sizes
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    here = cells.join(sizes, F.col("cell") == F.col("of")).select("id", "vec", "cell", every.alias("block"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    asking = queries.join(sizes, F.col("cell") == F.col("of")).select("id", "vec", "cell", "bound", block.alias("block"))
    return here, asking


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k nearest found of every query (a condition on
    the id column), nearest first, ties to the smaller id."""
    rows = _valid(vectors, id_col, vec_col)
    first = Window.partitionBy("vec").orderBy("id")
    one = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
    one = kept(one.withColumn("dim", F.size("vec")))
    asked = rows.select(F.col("id").alias(id_col), "vec").where(is_query).groupBy(F.col(id_col).alias("id")).agg(F.min("vec").alias("vec"))
    asked = asked.withColumn("dim", F.size("vec"))
    splits = _splits(one)

    def cell_of(vec: Column) -> Column:
        @F.pandas_udf("long")
        def run(column: pd.Series) -> pd.Series:
            out = np.zeros(len(column), np.int64)
            dims = column.map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                out[at] = splits[int(dim)].cell_of(project(unit(_stack(column.iloc[at]))))
            return pd.Series(out)

        return run(vec)

    if not splits:
        return one.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    cells = kept(one.select("id", "vec", cell_of(F.col("vec")).alias("cell")))
    asked = kept(asked.select("id", "vec", cell_of(F.col("vec")).alias("cell")))
    few_cells = sum(len(split.cells) for split in splits.values()) * 32 <= BROADCAST_BYTES

    def found(queries: DataFrame) -> DataFrame:
        def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            out = search_cell(mine["id"].to_numpy(), _stack(mine["vec"]), theirs, k) if len(mine) and len(theirs) else []
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        here, asking = dealt(cells, queries, few_cells)
        pair = here.groupBy("cell", "block").cogroup(asking.groupBy("cell", "block"))
        return pair.applyInPandas(run, "query_id long, vec_id long, score double")

    home = kept(found(asked.select("id", "vec", "cell", F.lit(float("-inf")).alias("bound"))))
    reached = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf")))

    @F.pandas_udf("array<long>")
    def open_cells(column: pd.Series, homes: pd.Series, bounds: pd.Series) -> pd.Series:
        out = []
        for vec, cell, least in zip(column, homes, bounds, strict=True):
            split = splits[len(vec)]
            point = project(unit(np.asarray(vec, np.float64)[None, :]))[0]
            out.append(split.open_cells(point, max(STOP * _distance(least), 1e-9), int(cell)))
        return pd.Series(out)

    asked = asked.join(reached, asked["id"] == reached["query_id"], "left").select("id", "vec", "cell", F.coalesce(bound, F.lit(float("-inf"))).alias("bound"))
    more = kept(asked.select("id", "vec", "bound", F.explode(open_cells("vec", "cell", "bound")).alias("cell")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = home.union(found(more)).withColumn("rank", F.row_number().over(best))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _splits(rows: DataFrame) -> dict[int, Split]:
    """The top of the tree for each vector length, from at most SAMPLE vectors each."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one per vector length
    out: dict[int, Split] = {}
    first = 0
    for dim, n in sorted(sizes.items()):
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()
        out[dim] = Split(project(unit(_stack(some["vec"]))), blocks_for(n, CELL), first)
        first += len(out[dim].cells)
    return out
