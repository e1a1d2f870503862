"""Fidelity of the numeric conventions to the reports' original engine (SQLite, through
Python's sqlite3 with our own statements), plus small fixtures for the uniqueness audit and
the trend labels."""

import sqlite3

import pytest
from pyspark.sql import functions as F

import fixtures
from panelscope.functions.expr import pct_of, round_half_up
from panelscope.plans.reports import REPORTS
from panelscope.sources import load_tables
from panelscope.sources.schema import OBSERVATIONS


def _grid(spark, max_n):
    n = spark.range(1, max_n + 1).withColumnRenamed("id", "n")
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_ratio_rounding_matches_sqlite(spark, digits):
    # AVG(flag) = k/n and SUM(...) * 100.0 / COUNT(*) forms over all ratios with n <= 120.
    df = _grid(spark, 120).select(
        "n",
        "k",
        round_half_up(F.col("k") / F.col("n"), digits).alias("avg_r"),
        pct_of(F.col("k"), F.col("n"), digits).alias("pct_r"),
    )
    ours = {(r.n, r.k): (r.avg_r, r.pct_r) for r in df.collect()}
    con = sqlite3.connect(":memory:")
    bad = []
    for (n, k), (avg_r, pct_r) in ours.items():
        a, p = con.execute(f"SELECT ROUND(CAST({k} AS REAL) / {n}, {digits}), ROUND({k} * 100.0 / {n}, {digits})").fetchone()
        if a != avg_r or p != pct_r:
            bad.append((n, k, a, avg_r, p, pct_r))
    assert not bad, bad[:5]


def test_duplicate_key_audit(spark, tmp_path):
    obs = fixtures._observations()
    dup = list(obs[0])
    dup[0] = 10**9  # new observation_id, same (settlement_id, round_id)
    path = fixtures.build(spark, str(tmp_path), observations=obs + [tuple(dup)])
    t = load_tables(spark, path)
    got = {(r.table_name, r.key_columns): (r.duplicate_keys, r.duplicate_rows) for r in REPORTS["dq_unique_keys"](t).collect()}
    assert got[("observations", "settlement_id,round_id")] == (1, 2)
    assert got[("observations", "observation_id")] == (0, 0)


def test_school_trend_labels(spark, tmp_path):
    # School access by round: 50 %, 40 %, 40 %, 60 % -> Stable (first), Declined, Stable, Improved.
    provinces = [(1, "P1", "P01")]
    districts = [(1, "P0101", "D1", 1)]
    settlements = [(i, f"C{i}", f"S{i}", "P0101", None, None, None, None) for i in range(10)]
    rounds = fixtures.ROUNDS[:4]
    share = {1: 5, 2: 4, 3: 4, 4: 6}
    cols = OBSERVATIONS.fieldNames()
    obs = []
    for r, ones in share.items():
        for i in range(10):
            row = dict.fromkeys(cols)
            row.update(observation_id=r * 100 + i, settlement_id=i, round_id=r, schools_available=int(i < ones))
            obs.append(tuple(row[c] for c in cols))
    path = fixtures.build(
        spark, str(tmp_path), observations=obs, provinces=provinces, districts=districts, settlements=settlements,
        survey_rounds=rounds,
    )
    got = [(r.round_label, r.school_access_pct, r.school_trend) for r in REPORTS["s7_school_trend"](load_tables(spark, path)).collect()]
    assert sorted(got) == [
        ("Round 10", 50.0, "— Stable"),
        ("Round 11", 40.0, "⚠ Declined"),
        ("Round 12", 40.0, "— Stable"),
        ("Round 13", 60.0, "✓ Improved"),
    ]


def _panel(spark, tmp_path, cells):
    """Tiny fact: ``cells`` = {(province, settlement, round, treated): (idp, security)}."""
    provinces = sorted({(p, f"P{p}", f"P{p:02d}") for p, *_ in cells})
    districts = [(p, f"P{p:02d}01", f"D{p}", p) for p, _, _ in provinces]
    settlements = sorted({(s, f"C{s}", f"S{s}", f"P{p:02d}01", None, None, None, None) for p, s, _, _ in cells})
    cols = OBSERVATIONS.fieldNames()
    obs = []
    for i, ((p, s, r, treated), (idp, sec)) in enumerate(sorted(cells.items())):
        row = dict.fromkeys(cols)
        row.update(
            observation_id=i + 1, settlement_id=s, round_id=r, idp_arrivals=idp, security_situation=sec,
            post_intervention=int(r >= 4), diff_in_diff=treated, health_clinics_available=1, schools_available=1,
            humanitarian_aid_delivered=0,
        )
        obs.append(tuple(row[c] for c in cols))
    path = fixtures.build(spark, str(tmp_path), observations=obs, provinces=provinces, districts=districts, settlements=settlements)
    return load_tables(spark, path)


def test_all_zero_metric_gives_null_index(spark, tmp_path):
    t = _panel(spark, tmp_path, {(1, 10, 1, 0): (5, 0), (2, 20, 1, 1): (7, 0)})
    rows = REPORTS["c2x_vulnerability_index"](t).collect()
    assert len(rows) == 2 and all(r.vulnerability_index is None for r in rows)
    assert all(r.avg_security_score == 0.0 for r in rows)


def test_did_missing_cell_and_signs(spark, tmp_path):
    cells = {
        # province 1: treated change 10, control change 10 -> 0, "No effect"
        (1, 11, 1, 1): (10, 1), (1, 11, 4, 1): (20, 1), (1, 12, 1, 0): (5, 1), (1, 12, 4, 0): (15, 1),
        # province 2: treated change -6, control change 4 -> -10, reduced
        (2, 21, 1, 1): (16, 1), (2, 21, 4, 1): (10, 1), (2, 22, 1, 0): (1, 1), (2, 22, 4, 0): (5, 1),
        # province 3: treated change 9, control change 1 -> 8, increased
        (3, 31, 1, 1): (1, 1), (3, 31, 4, 1): (10, 1), (3, 32, 1, 0): (2, 1), (3, 32, 4, 0): (3, 1),
        # province 4: no treated-pre cell -> dropped
        (4, 41, 4, 1): (3, 1), (4, 42, 1, 0): (3, 1), (4, 42, 4, 0): (3, 1),
    }
    t = _panel(spark, tmp_path, cells)
    got = {r.province_name: (r.did_estimate, r.interpretation) for r in REPORTS["did_by_province"](t).collect()}
    assert got == {
        "P1": (0.0, "No effect"),
        "P2": (-10.0, "Intervention reduced displacement"),
        "P3": (8.0, "Displacement increased despite intervention"),
    }
    # Without any treated-pre row in the whole panel the estimator is NULL, not an error.
    only = {k: v for k, v in cells.items() if not (k[3] == 1 and k[2] < 4)}
    t2 = _panel(spark, tmp_path / "no_tc", only)
    est = REPORTS["did_estimator"](t2).first()
    assert est.did_estimator_idp_arrivals is None and est.treatment_group_change is None
    assert est.control_group_change is not None
