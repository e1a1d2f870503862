"""Loaders, the layout writer and flat-file normalisation."""

import os

import duckdb
from pyspark.sql import functions as F

import fixtures
from helpers import assert_same
from panelscope.plans.oracle import REPORT_SQL
from panelscope.plans.reports import REPORTS
from panelscope.sources import load_tables, write_tables
from panelscope.sources.flat import normalize_flat
from panelscope.sources.schema import SCHEMAS


def _write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        f.write(header + "\r\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\r\n")


def test_csv_seed_format(spark, tmp_path):
    d = str(tmp_path)
    for name, rows in {
        "provinces": fixtures.PROVINCES,
        "districts": fixtures.DISTRICTS,
        "survey_rounds": fixtures.ROUNDS,
        "settlements": fixtures._settlements(),
        "observations": fixtures._observations(),
    }.items():
        _write_csv(f"{d}/{name}.csv", ",".join(SCHEMAS[name].fieldNames()), rows)
    t = load_tables(spark, d, fmt="csv")
    assert t.provinces.count() == 4 and t.survey_rounds.count() == 6
    assert t.survey_rounds.where(F.col("round_period") == "2022").count() == 1  # CRLF stripped
    assert [f.dataType.simpleString() for f in t.observations.schema.fields][:3] == ["bigint", "bigint", "int"]
    # Same report results as from Parquet.
    p = fixtures.build(spark, f"{d}/pq")
    con = duckdb.connect()
    fixtures.duck(con, p)
    for key in ("v4_national_dashboard", "q2a_province_burden", "l2_surges"):
        assert_same(REPORTS[key](t), con.sql(REPORT_SQL[key]))


def test_write_layout_partitions_by_round(spark, tmp_path):
    src = fixtures.build(spark, str(tmp_path / "src"))
    t = load_tables(spark, src)
    out = str(tmp_path / "laid")
    write_tables(t, out, num_partitions=3)
    assert sorted(x for x in os.listdir(f"{out}/observations") if x.startswith("round_id=")) == [
        f"round_id={r}" for r in range(1, 7)
    ]
    t2 = load_tables(spark, out)
    assert t2.observations.schema == t.observations.select(*SCHEMAS["observations"].fieldNames()).schema
    con = duckdb.connect()
    fixtures.duck(con, src)
    assert_same(REPORTS["w1_panel_longitudinal"](t2), con.sql(REPORT_SQL["w1_panel_longitudinal"]))


def test_normalize_flat_round_trip(spark, tmp_path):
    src = fixtures.build(spark, str(tmp_path / "src"))
    t = load_tables(spark, src)
    # A flat extract: the denormalised view plus the codes it leaves out.
    flat = REPORTS["v2_observations_full"](t).join(
        REPORTS["v1_settlement_full"](t).select("settlement_code", "adm2_code", "pashtun_greg", "pashtun_ethno"),
        "settlement_code",
    )
    n = normalize_flat(flat)
    out = str(tmp_path / "norm")
    write_tables(n, out)
    t2 = load_tables(spark, out)
    assert t2.provinces.count() == 3  # provinces with settlements and observations
    assert t2.observations.count() == REPORTS["v2_observations_full"](t).count()
    assert t2.settlements.select("settlement_id").distinct().count() == t2.settlements.count()
    # Id-independent reports agree with the originals.
    for key in ("q4b_aid_by_province", "s2_aid_tiers", "s3_districts_always_aided", "l2_surges", "did_by_province", "w2_moving_avg_security"):
        a = REPORTS[key](t2).collect()
        b = REPORTS[key](t).collect()
        assert sorted(map(str, a)) == sorted(map(str, b)), key


def test_cli_writes_reports(spark, tmp_path):
    from panelscope.cli import run

    src = fixtures.build(spark, str(tmp_path / "src"))
    run(spark, src, "parquet", str(tmp_path / "out"), ["v4_national_dashboard", "q2a_province_burden"])
    t = load_tables(spark, src)
    got = spark.read.parquet(str(tmp_path / "out" / "v4_national_dashboard"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, REPORTS["v4_national_dashboard"](t).collect()))


def test_csv_header_must_match_schema(spark, tmp_path):
    import pytest

    d = str(tmp_path)
    for name, rows in {"provinces": fixtures.PROVINCES, "districts": fixtures.DISTRICTS, "survey_rounds": fixtures.ROUNDS,
                       "settlements": fixtures._settlements(), "observations": fixtures._observations()[:10]}.items():
        header = ",".join(SCHEMAS[name].fieldNames())
        if name == "provinces":
            header = "province_id,adm1_code,province_name"  # columns swapped
        _write_csv(f"{d}/{name}.csv", header, rows)
    t = load_tables(spark, d, fmt="csv")
    with pytest.raises(Exception):
        t.provinces.collect()
