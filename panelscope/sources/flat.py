"""Normalise a flat (one row per settlement x round, geography repeated on every row) extract
into the five canonical tables.

The flat rows' distinct places (a row per settlement, unless rows disagree) and distinct rounds are
found first and kept in the shared checkpoint folder; every dimension is an aggregation of these by
its code, and is kept as well. Rows of one code that disagree on an attribute
are not dropped in silence: the smallest variant (by the attributes in order) is taken, and
``flat_conflicts`` lists the codes with their number of variants.

Ids are the same however often the tables are read: provinces, districts and rounds, of which
there are few, are numbered in the order of their codes; settlements, which grow with the
panel, by a running count over ranges of their codes (``unit_scan``); an observation's id is
made of its settlement's and its round's, so rows that repeat both show as duplicate keys.

A row without one of the four codes has no place in the panel: ``normalize_flat`` leaves it out and
``flat_rejects`` lists it with the reason, so normalised rows and rejected ones are all rows.
Ids that stay over several loads: ``FlatStore`` (flat_store.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.operators.panel import unit_scan
from panelscope.sources.schema import OBSERVATIONS, SCHEMAS
from panelscope.sources.tables import Tables, broadcast_if_small, shared_dir

SETTLEMENT_COLS = ["settlement_code", "settlement_name", "longitude", "latitude", "pashtun_greg", "pashtun_ethno"]
MEASURES = [f for f in OBSERVATIONS.fieldNames() if f not in ("observation_id", "settlement_id", "round_id")]
# table -> (code, its attributes)
DIMENSIONS = {
    "provinces": ("adm1_code", ["province_name"]),
    "districts": ("adm2_code", ["district_name", "adm1_code"]),
    "settlements": ("settlement_code", [*SETTLEMENT_COLS[1:], "adm2_code"]),
    "survey_rounds": ("round_label", ["round_period"]),
}


def reject_reason() -> Column:
    """Why a flat row can't be normalised (its first missing code), NULL when it can."""
    codes = [code for code, _ in DIMENSIONS.values()]
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in codes])


def flat_rejects(flat: DataFrame) -> DataFrame:
    """The rows that ``normalize_flat`` leaves out, with ``reason``."""
    return flat.withColumn("reason", reject_reason()).where("reason IS NOT NULL")


def distinct_codes(flat: DataFrame) -> dict[str, DataFrame]:
    """Distinct codes and attributes of the rows, by dimension: places serve three of them."""
    shared_dir(flat.sparkSession)
    columns = {t: [code, *attributes] for t, (code, attributes) in DIMENSIONS.items()}
    of_place = dict.fromkeys(c for t in ("provinces", "districts", "settlements") for c in columns[t])
    places = flat.select(*of_place).distinct().checkpoint()
    rounds = flat.select(*columns["survey_rounds"]).distinct()
    return {t: rounds if t == "survey_rounds" else places for t in DIMENSIONS}


def dimension(distinct: dict[str, DataFrame], table: str) -> DataFrame:
    """The codes of a dimension with their (smallest) attributes and ``variants``."""
    code, attributes = DIMENSIONS[table]
    variants = distinct[table].select(code, F.struct(*attributes).alias("a")).distinct()
    rows = variants.groupBy(code).agg(F.min("a").alias("a"), F.count(F.lit(1)).alias("variants"))
    return rows.select(code, "a.*", "variants").checkpoint()


def flat_conflicts(flat: DataFrame) -> DataFrame:
    """(table_name, code, variants) of the codes whose rows disagree on an attribute."""
    out, distinct = None, distinct_codes(flat)
    for table, (code, _) in DIMENSIONS.items():
        rows = dimension(distinct, table).where("variants > 1")
        rows = rows.select(F.lit(table).alias("table_name"), F.col(code).cast("string").alias("code"), "variants")
        out = rows if out is None else out.unionByName(rows)
    return out


def _numbered(rows: DataFrame, id_name: str, kind: str, *order) -> DataFrame:
    return rows.withColumn(id_name, F.row_number().over(Window.orderBy(*order)).cast(kind))


def normalize_flat(flat: DataFrame, num_partitions: int | None = None) -> Tables:
    """Split ``flat`` (geography, settlement and round columns, and the measures) into Tables.
    Rounds are ordered by the number in ``round_label``; rows of ``flat_rejects`` are left out.
    Write the result with ``write_tables`` before using it repeatedly."""
    flat = flat.where(reject_reason().isNull())
    distinct = distinct_codes(flat)
    provinces = _numbered(dimension(distinct, "provinces"), "province_id", "long", "adm1_code")
    districts = dimension(distinct, "districts").join(broadcast_if_small(provinces.select("province_id", "adm1_code")), "adm1_code")
    districts = _numbered(districts, "district_id", "long", "adm2_code")
    number = F.regexp_extract("round_label", r"(\d+)", 1)
    rounds = _numbered(dimension(distinct, "survey_rounds"), "round_id", "int", F.nullif(number, F.lit("")).cast("int"), "round_label")

    settlements = dimension(distinct, "settlements").withColumns({"one": F.lit(1), "all": F.lit(0)})
    settlements = unit_scan(settlements, "all", ["settlement_code"], "one", cum="settlement_id", partitions=num_partitions)
    settlements = settlements.withColumn("settlement_id", F.col("settlement_id").cast("long"))

    n_rounds = rounds.agg(F.max("round_id")).first()[0] or 1
    rounds_key = broadcast_if_small(rounds.select("round_id", "round_label"))
    fact = flat.select("settlement_code", "round_label", *MEASURES).join(settlements.select("settlement_code", "settlement_id"), "settlement_code")
    observations = fact.join(rounds_key, "round_label").withColumn(
        "observation_id", (F.col("settlement_id") - 1) * n_rounds + F.col("round_id")
    )
    frames = {
        "provinces": provinces,
        "districts": districts,
        "settlements": settlements,
        "survey_rounds": rounds,
        "observations": observations,
    }
    return Tables(**{name: frame.select(*SCHEMAS[name].fieldNames()) for name, frame in frames.items()})
