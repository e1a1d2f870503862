"""Declared schemas of the five canonical tables and their constraints.

INTEGER ids and measures map to LongType, 0/1 flags, 0-5 levels and round_id to
IntegerType, REAL to DoubleType, TEXT to StringType. Constraints are not enforced on
write (Parquet has none); they are listed here so the audit operators can check them.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PROVINCES = _struct(
    ("province_id", L, False),
    ("province_name", S, False),
    ("adm1_code", S, False),
)

DISTRICTS = _struct(
    ("district_id", L, False),
    ("adm2_code", S, False),
    ("district_name", S, False),
    ("province_id", L, False),
)

SETTLEMENTS = _struct(
    ("settlement_id", L, False),
    ("settlement_code", S, False),
    ("settlement_name", S, True),
    ("adm2_code", S, False),
    ("longitude", D, True),
    ("latitude", D, True),
    ("pashtun_greg", D, True),
    ("pashtun_ethno", D, True),
)

SURVEY_ROUNDS = _struct(
    ("round_id", I, False),
    ("round_label", S, False),
    ("round_period", S, False),
)

SEVERITY_COLS = ["idp_conflict_severity", "idp_disaster_severity", "security_situation"]
SERVICE_FLAGS = ["health_clinics_available", "schools_available"]
AID_FLAGS = [
    "humanitarian_aid_delivered",
    "aid_emergency_shelter",
    "aid_food_distribution",
    "aid_cash",
    "aid_infrastructure",
]
DID_FLAGS = ["post_intervention", "diff_in_diff"]
RESOLUTION_COLS = [f"conflict_res_{k}" for k in range(1, 6)] + [
    f"disaster_res_{k}" for k in range(1, 6)
]

OBSERVATIONS = _struct(
    ("observation_id", L, False),
    ("settlement_id", L, False),
    ("round_id", I, False),
    ("host_population", L, True),
    ("idp_arrivals", L, True),
    ("change_idp_arrivals", D, True),
    *[(c, I, True) for c in SEVERITY_COLS + SERVICE_FLAGS + AID_FLAGS + DID_FLAGS + RESOLUTION_COLS],
)

TABLE_NAMES = ["provinces", "districts", "settlements", "survey_rounds", "observations"]

SCHEMAS: dict[str, T.StructType] = {
    "provinces": PROVINCES,
    "districts": DISTRICTS,
    "settlements": SETTLEMENTS,
    "survey_rounds": SURVEY_ROUNDS,
    "observations": OBSERVATIONS,
}

# Declared keys: primary keys, UNIQUE columns, foreign keys and value domains.
PRIMARY_KEYS = {
    "provinces": ["province_id"],
    "districts": ["district_id"],
    "settlements": ["settlement_id"],
    "survey_rounds": ["round_id"],
    "observations": ["observation_id"],
}
UNIQUE_KEYS = {
    "provinces": [["adm1_code"]],
    "districts": [["adm2_code"]],
    "settlements": [["settlement_code"]],
    "observations": [["settlement_id", "round_id"]],
}
# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("districts", "province_id", "provinces", "province_id"),
    ("settlements", "adm2_code", "districts", "adm2_code"),
    ("observations", "settlement_id", "settlements", "settlement_id"),
    ("observations", "round_id", "survey_rounds", "round_id"),
]
# column -> (low, high) inclusive
DOMAINS = {
    **{c: (0, 5) for c in SEVERITY_COLS},
    **{c: (0, 1) for c in SERVICE_FLAGS + AID_FLAGS + DID_FLAGS + RESOLUTION_COLS},
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]
