"""Hand-made canonical tables with the edge cases the reports must get right.

Rows are generated from a seeded rule (so LIMITs bite and ties occur) and then
overridden with the specific cases: NULL measures, a zero previous value, an exact +50 %
step, ties, an unbalanced settlement, a district name shared by two provinces, orphan
keys at every level, NULL coordinates, a missing DiD cell and school-access trends that
fall, rise and stay equal.
"""

from __future__ import annotations

import random

from panelscope.sources.schema import OBSERVATIONS, SCHEMAS

PROVINCES = [(1, "Alpha", "P01"), (2, "Beta", "P02"), (3, "Gamma", "P03"), (4, "Delta", "P04")]
DISTRICTS = [
    (10, "P0101", "Tagab", 1),
    (11, "P0102", "North", 1),
    (20, "P0201", "Tagab", 2),  # same name as district 10, other province
    (21, "P0202", "South", 2),
    (30, "P0301", "East", 3),
    (99, "P9901", "Lost", 99),  # province 99 does not exist
]
ROUNDS = [
    (1, "Round 10", "Jun 2020"),
    (2, "Round 11", "Dec 2020"),
    (3, "Round 12", "Mar 2021"),
    (4, "Round 13", "Jun 2021"),
    (5, "Round 14", "Dec 2021"),
    (6, "Round 16", "2022"),
]
OBS_COLS = OBSERVATIONS.fieldNames()


def _settlements():
    rows = []
    adm2 = ["P0101", "P0102", "P0201", "P0202", "P0301"]
    for i in range(60):
        sid = 100 + i
        lat = None if i % 17 == 0 else 34.0 + (i % 9) * 0.5  # 36.0 exactly occurs: not > 36
        lon = None if lat is None else 62.0 + i / 10
        name = None if i == 7 else f"S{sid}"
        rows.append((sid, f"C{sid}", name, adm2[i % 5], lon, lat, (i % 10) / 10, (i % 7) / 7))
    rows.append((901, "C901", "S901", "P9999", 65.0, 37.0, 0.1, 0.1))  # unknown district
    rows.append((902, "C902", "S902", "P9901", 65.0, 37.5, 0.1, 0.1))  # district without province
    return rows


def _observations():
    rng = random.Random(7)
    rows = {}
    sids = [100 + i for i in range(60)] + [901, 902, 999]  # 999: no settlement row
    for sid in sids:
        prev = None
        for r in range(1, 7):
            idp = rng.choice([0, 0, 40, 120, 300, 600, 900, 1100, 1500, 2400, 3100])
            sec = rng.randint(0, 5)
            conf, dis = rng.randint(0, 5), rng.randint(0, 5)
            health, schools = rng.randint(0, 1), int(rng.random() < (0.7 - 0.08 * r))
            aid = int(rng.random() < 0.2 + 0.1 * r)
            flags = [int(rng.random() < 0.4) for _ in range(4)]
            did = sid % 2
            change = None if prev in (None, 0) else (idp - prev) * 100.0 / prev
            host = None if rng.random() < 0.1 else rng.randint(100, 9000)
            row = {
                "observation_id": sid * 6 + r,
                "settlement_id": sid,
                "round_id": r,
                "host_population": host,
                "idp_arrivals": idp,
                "change_idp_arrivals": change,
                "idp_conflict_severity": conf,
                "idp_disaster_severity": dis,
                "security_situation": sec,
                "health_clinics_available": health,
                "schools_available": schools,
                "humanitarian_aid_delivered": aid,
                "aid_emergency_shelter": flags[0],
                "aid_food_distribution": flags[1],
                "aid_cash": flags[2],
                "aid_infrastructure": flags[3],
                "post_intervention": int(r >= 4),
                "diff_in_diff": did,
            }
            for k in range(1, 6):
                row[f"conflict_res_{k}"] = int(conf >= k)
                row[f"disaster_res_{k}"] = int(dis >= k)
            rows[(sid, r)] = row
            prev = idp

    def put(sid, r, **kw):
        rows[(sid, r)].update(kw)

    put(101, 3, idp_arrivals=None)  # NULL measure
    put(102, 6, security_situation=None)  # NULL level: own group, NULL score
    put(103, 1, idp_arrivals=0)
    put(103, 2, idp_arrivals=10)  # zero previous: no surge, NULL pct
    put(104, 1, idp_arrivals=100)
    put(104, 2, idp_arrivals=150)  # exactly +50 %: not a surge
    put(104, 3, idp_arrivals=301)
    put(105, 6, idp_arrivals=2400, humanitarian_aid_delivered=0)  # ties with 110 in province 1
    put(110, 6, idp_arrivals=2400, humanitarian_aid_delivered=0)
    put(106, 6, idp_arrivals=750, humanitarian_aid_delivered=0, security_situation=2)  # 750 div 100 = 7
    put(107, 5, health_clinics_available=None, schools_available=None)
    del rows[(108, 3)]  # unbalanced panel: LAG steps from round 2 to round 4
    # Province 3 (settlements i % 5 == 4): treatment only after the intervention.
    for sid in [100 + i for i in range(60) if i % 5 == 4]:
        for r in range(1, 7):
            if (sid, r) in rows:
                rows[(sid, r)]["diff_in_diff"] = int(r >= 4)
    return [tuple(row[c] for c in OBS_COLS) for row in rows.values()]


def build(spark, path, observations=None, **overrides):
    """Write the fixture tables to ``path/{table}`` (plain Parquet) and return path."""
    data = {
        "provinces": PROVINCES,
        "districts": DISTRICTS,
        "settlements": _settlements(),
        "survey_rounds": ROUNDS,
        "observations": _observations() if observations is None else observations,
    }
    data.update(overrides)
    for name, rows in data.items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def duck(con, path):
    for name in SCHEMAS:
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
