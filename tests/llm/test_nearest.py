import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelscope.llm import ann
from panelscope.llm.ann import Split, Tree, chi_square, nearest, project, unit

SCHEMA = "vec_id long, embedding array<float>, label int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def brute(rows, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in ok.items():
        if q % 50 == 0:
            s = [(-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for i, b in ok.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 500)
    monkeypatch.setattr(ann, "BLOCK", 20)
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(4000, 32, 1))]
    got, want = results(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in exact)


def test_copies_ties_and_edges(spark):
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, same) for i in range(100, 400)] + [(50, other), (7, [2.0, 2.0, 3.0]), (8, None), (9, []), (10, [0.0] * 3)]
    rows += [(11, [1.0, None, 2.0]), (12, [1.0, float("nan"), 2.0]), (13, [float("inf"), 1.0, 1.0]), (None, same), (7, [2.0, 2.0, 3.0])]
    rows += [(14, [1.0, 0.0]), (15, [1.0, 1.0])]
    got = results(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    want = brute(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[350]] == [100, 101, 102, 103, 104]


def test_few_candidates_and_empty_tables(spark):
    assert results(nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]), F.col("vec_id") % 50 == 0))[0][0][0] == 1
    assert nearest(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_gives_leaves_in_order_and_regions_bound_distances():
    points = project(unit(clusters(1000, 16, 2).astype(float)))
    q = points[3]
    seen, last = [], 0.0
    for r, rows in Tree(points).nearest(q):
        assert r >= last
        last = r
        assert (((points[rows] - q) ** 2).sum(axis=1) >= r - 1e-9).all()
        seen += rows.tolist()
    assert sorted(seen) == list(range(1000))
    split = Split(points, 8, 0)
    cell = split.cell_of(points)
    for reach in (1.0, 9.0):
        near = set(split.open_cells(q, reach, int(cell[3]))) | {int(cell[3])}
        inside = ((points - q) ** 2).sum(axis=1) <= reach
        assert set(cell[inside].tolist()) <= near


def test_chi_square_against_simulation():
    x = (np.random.default_rng(0).normal(size=(200_000, ann.DIMS)) ** 2).sum(axis=1)
    for at in (3.0, 8.0, 15.0):
        assert abs(chi_square(at) - (x <= at).mean()) < 0.005
    assert abs(chi_square(ann.STOP) - ann.CERTAINTY) < 1e-6


def test_stopping_test_loses_no_more_than_its_certainty(monkeypatch):
    """One vector a leaf, so that the search of a cell ends by the stopping test alone."""
    monkeypatch.setattr(ann, "LEAF", 1)
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 32))
    rows = rows + 0.05 * rng.normal(size=rows.shape)
    asked = np.arange(0, len(rows), 4)
    scores = unit(rows)[asked] @ unit(rows).T
    scores[np.arange(len(asked)), asked] = -9
    queries = pd.DataFrame({"id": asked, "vec": list(rows[asked]), "bound": -np.inf})
    got = {q: v for q, v, _ in ann.search_cell(np.arange(len(rows)), rows, queries, 1)}
    assert np.mean([got[q] == v for q, v in zip(asked.tolist(), scores.argmax(axis=1), strict=True)]) >= 0.985


def test_recall_over_many_cells_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 500)
    monkeypatch.setattr(ann, "LEAF", 16)
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(4000, 32, 5))]
    got, want = results(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits / (5 * len(want)) >= 0.98


def test_cells_are_sent_as_often_as_their_own_queries_ask(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    cells = spark.range(300).select("id", F.array(F.lit(1.0)).alias("vec"), (F.col("id") % 3).alias("cell"))
    asked = spark.range(126).select("id", F.array(F.lit(1.0)).alias("vec"), F.when(F.col("id") < 125, 0).otherwise(2).cast("long").alias("cell"), F.lit(0.0).alias("bound"))
    for few in (True, False):
        here, asking = ann.dealt(cells, asked, few)
        # cell 0 has 125 queries: 13 blocks; cell 1 none; cell 2 one
        assert {r["cell"]: r["count"] for r in here.groupBy("cell").count().collect()} == {0: 1300, 2: 100}
        assert asking.count() == 126 and asking.select("cell", "block").distinct().count() <= 14


def test_sizes_of_components_do_not_matter(spark):
    """Doubles whose squares overflow or vanish: the same neighbours as of the vectors over their largest component."""
    vectors = {i: v * 10.0 ** (i % 5 * 60 - 120) for i, v in enumerate(clusters(300, 8, 4).astype(float))}
    vectors |= {50 * i + 3000: np.array([1e308, 1e307 * (i + 1), -1e300, 0.0, 5e-324, 1.0, 0.0, 0.0]) for i in range(4)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = results(nearest(df, F.col("vec_id") % 50 == 0))
    ids = np.array(list(vectors))
    units = unit(np.array([v / np.abs(v).max() for v in vectors.values()]))
    assert sorted(got) == [i for i in ids.tolist() if i % 50 == 0]
    for q, found in got.items():
        scores = units @ units[ids == q][0]
        order = [int(i) for _, i in sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) if i != q][:5]
        assert [i for i, _ in found] == order
        assert np.allclose([s for _, s in found], [scores[ids == i][0] for i in order], rtol=1e-9)
