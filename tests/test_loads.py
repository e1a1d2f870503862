"""Loads that keep bad rows, and flat loads whose ids stay."""

import random
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import fixtures
from panelscope.operators.distinct import distinct_units, unit_bitmaps
from panelscope.plans.reports import REPORTS
from panelscope.plans.store import ViewStore
from panelscope.plans.views import VIEWS, register_views
from panelscope.sources import load_tables
from panelscope.sources.checked import load_checked
from panelscope.sources.flat import flat_rejects, normalize_flat
from panelscope.sources.flat_store import FlatStore
from panelscope.sources.rejects import split_repeats
from panelscope.sources.schema import SCHEMAS
from panelscope.sources.tables import Tables


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


# ── repeated keys ──


def test_split_repeats_matches_plain(spark):
    random.seed(2)
    rows = [(random.randrange(30), random.randrange(3), random.choice([None, "a", "b"]), random.choice([None, 1.5])) for _ in range(120)]
    rows += [(7, 1, "hot", 2.0)] * 200 + [(1000 + i, 0, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, j long, a string, b double")
    first, surplus = split_repeats(df, ["k", "j"])
    low = {}
    for r in rows:
        rank = tuple((v is not None, v or "") if i == 2 else (v is not None, v or 0) for i, v in enumerate(r))
        if r[:2] not in low or rank < low[r[:2]][0]:
            low[r[:2]] = (rank, r)
    want = Counter(r for _, r in low.values())
    assert Counter(map(tuple, first.collect())) == want
    assert Counter(map(tuple, surplus.collect())) == Counter(rows) - want
    none, no_surplus = split_repeats(df.where("false"), ["k"])
    assert none.count() == no_surplus.count() == 0


# ── CSV with a reject table ──


def seed(path):
    return {
        "provinces": fixtures.PROVINCES,
        "districts": fixtures.DISTRICTS,
        "survey_rounds": fixtures.ROUNDS,
        "settlements": fixtures._settlements(),
        "observations": fixtures._observations(),
    }


def write_csv(path, tables, extra=None):
    for name, rows in tables.items():
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(",".join(SCHEMAS[name].fieldNames()) + "\n")
            for r in rows:
                f.write(",".join("" if v is None else str(v) for v in r) + "\n")
            for line in (extra or {}).get(name, []):
                f.write(line + "\n")


def test_a_bad_file_loads_and_adds_up(spark, tmp_path):
    tables = seed(tmp_path)
    good = tables["observations"][0]
    width = len(good)
    line = lambda **kw: ",".join(
        "" if v is None else str(v) for v in [kw.get(c, x) for c, x in zip(SCHEMAS["observations"].fieldNames(), good, strict=True)]
    )
    extra = {
        "observations": [
            "1,2,3",  # too few fields
            ",".join(["1"] * (width + 2)),  # too many
            line(observation_id=90001, idp_arrivals="many"),
            line(observation_id=90002, round_id="1.5"),
            line(observation_id=None),
            line(observation_id=90003, security_situation=7),
            line(observation_id=90004, settlement_id=123456),
            line(observation_id=90005, round_id=77),
            line(),  # a copy
            line(),
            line(observation_id=90006),  # another row of the same settlement and round
            line(observation_id="9" * 25),
        ],
        "provinces": ["5,,P05", "6,Zeta,P01"],
    }
    write_csv(tmp_path, tables, extra)
    load = load_checked(spark, str(tmp_path))
    for name, rows in tables.items():
        lines = len(rows) + len(extra.get(name, []))
        assert load.tables[name].count() + load.rejected.where(F.col("table_name") == name).count() == lines
        assert load.tables[name].schema.fieldNames() == SCHEMAS[name].fieldNames()
    rules = Counter((r["table_name"], r["rule"]) for r in load.rejected.collect())
    assert rules["provinces", "missing: province_name"] == 1 and rules["provinces", "repeated: adm1_code"] == 1
    for rule, n in {
        "malformed line": 2,
        "not a bigint: idp_arrivals": 1,
        "not a int: round_id": 1,
        "not a bigint: observation_id": 1,
        "missing: observation_id": 1,
        "out of range: security_situation": 1,
        "orphan: round_id": 1,
        "repeated: observation_id": 2,
        "repeated: settlement_id,round_id": 1,
    }.items():
        assert rules["observations", rule] == n, (rule, rules)
    # The parents that the files lack: settlement 999, district P9999, province 99 and what hangs on them.
    assert rules["districts", "orphan: province_id"] == 1 and rules["settlements", "orphan: adm2_code"] == 2
    assert rules["observations", "orphan: settlement_id"] == 1 + sum(r[1] in (901, 902, 999) for r in tables["observations"])
    bad = load.rejected.where("rule = 'malformed line'").select("line").collect()
    assert {"1,2,3"} < {r[0] for r in bad}
    assert '"idp_arrivals":"many"' in load.rejected.where("rule = 'not a bigint: idp_arrivals'").first()["line"]


def test_clean_and_empty_files_lose_nothing(spark, tmp_path):
    write_csv(tmp_path, {name: [] for name in SCHEMAS})
    load = load_checked(spark, str(tmp_path))
    assert load.rejected.count() == 0 and all(load.tables[n].count() == 0 for n in SCHEMAS)


def test_another_header_is_an_error(spark, tmp_path):
    write_csv(tmp_path, seed(tmp_path))
    (tmp_path / "provinces.csv").write_text("province_id,adm1_code,province_name\n1,P01,Alpha\n")
    with pytest.raises(Exception):
        load_checked(spark, str(tmp_path))


# ── flat extracts ──


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    return load_tables(spark, fixtures.build(spark, str(tmp_path_factory.mktemp("src"))))


def flat_of(t):
    more = t.settlements.select("settlement_code", "adm2_code", "pashtun_greg", "pashtun_ethno")
    return REPORTS["v2_observations_full"](t).join(more, "settlement_code").drop("observation_id")


def test_normalising_lists_what_it_leaves_out(spark, panel):
    flat = flat_of(panel)
    n, no_label = flat.count(), flat.where("round_id = 2 AND settlement_code <> 'C105'").count()
    nulls = F.when(F.col("round_id") != 2, F.col("round_label"))
    bad = flat.withColumn("settlement_code", F.when(F.col("settlement_code") != "C105", F.col("settlement_code"))).withColumn("round_label", nulls)
    away = flat_rejects(bad)
    reasons = {r["reason"]: r["count"] for r in away.groupBy("reason").count().collect()}
    assert reasons == {"missing: settlement_code": flat.where("settlement_code = 'C105'").count(), "missing: round_label": no_label}
    assert normalize_flat(bad).observations.count() + away.count() == n


def test_ids_stay_over_loads(spark, panel, tmp_path):
    flat = flat_of(panel)
    store = FlatStore(spark, str(tmp_path / "store"))
    early = flat.where("round_id <= 4 AND settlement_code <> 'C110'")
    one = store.append(early)
    assert (one.load, one.accepted, one.rejected, one.changed.count()) == (1, early.count(), 0, 0)
    codes = rows_of(store.keys("settlements"), "id", "settlement_code")
    old_ids = rows_of(store.observations(), "observation_id", "settlement_id", "round_id", "idp_arrivals")
    assert sorted(i for i, _ in codes) == list(range(1, len(codes) + 1))

    # All rows again, one settlement moved to another name, a copy and a conflicting row, missing codes.
    later = flat.withColumn("settlement_name", F.when(F.col("settlement_code") == "C101", "moved").otherwise(F.col("settlement_name")))
    later = later.unionByName(later.where("settlement_code = 'C110' AND round_id = 5"))
    later = later.unionByName(flat.where("settlement_code = 'C111' AND round_id = 6").withColumn("idp_arrivals", F.lit(-5).cast("long")))
    later = later.unionByName(flat.where("settlement_code = 'C112'").withColumn("settlement_code", F.lit(None).cast("string")))
    two = store.append(later)
    assert two.accepted + two.rejected == later.count()
    assert rows_of(two.changed) == [("settlements", "C101")]
    assert set(codes) <= set(rows_of(store.keys("settlements"), "id", "settlement_code"))
    assert set(old_ids) <= set(rows_of(store.observations(), "observation_id", "settlement_id", "round_id", "idp_arrivals"))
    reasons = {r["reason"]: r["count"] for r in store.rejected().groupBy("reason").count().collect()}
    assert reasons == {"already loaded": early.count(), "repeated": 2, "missing: settlement_code": 6}
    # The store has the whole panel now, with unique ids, and reports that go by codes agree.
    t = store.tables()
    assert t.observations.count() == flat.count() == t.observations.select("observation_id").distinct().count()
    assert t.observations.where("idp_arrivals = -5").count() == 1
    for table, key in [("settlements", "settlement_id"), ("districts", "district_id"), ("provinces", "province_id"), ("survey_rounds", "round_id")]:
        assert t[table].count() == t[table].select(key).distinct().count() == t[table].agg(F.max(key)).first()[0]
    assert rows_of(store.loads(), "load", "accepted", "rejected") == [(1, one.accepted, 0), (2, two.accepted, two.rejected)]
    assert rows_of(t.survey_rounds, "round_id", "round_label") == [(r[0], r[1]) for r in fixtures.ROUNDS]


def test_an_unfinished_load_is_not_read_and_is_done_again(spark, panel, tmp_path, monkeypatch):
    flat = flat_of(panel)
    store = FlatStore(spark, str(tmp_path / "store"))
    store.append(flat.where("round_id = 1"))
    before = rows_of(store.observations())
    monkeypatch.setattr(spark, "createDataFrame", None)  # the line in the table of loads can't be written
    with pytest.raises(TypeError):
        FlatStore(spark, store.path).append(flat)
    monkeypatch.undo()
    assert rows_of(store.observations()) == before and store.loads().count() == 1
    again = store.append(flat)
    assert again.load == 2 and store.observations().count() == flat.count()


def test_a_load_joins_its_rows_once(spark, panel, tmp_path, monkeypatch):
    # What earlier loads have comes with the dictionary: no joins with all their observations.
    flat, plans = flat_of(panel), {}
    again = flat.where("round_id >= 2").unionByName(flat.where("settlement_code = 'C111' AND round_id IN (1, 6)"))
    again = again.unionByName(flat.where("settlement_code = 'C111' AND round_id IN (1, 6)"))
    store = FlatStore(spark, str(tmp_path / "store"))
    store.append(flat.where("round_id <= 3"))
    write = DataFrameWriter.parquet

    def noted(self, path, *a, **k):
        plans[path.split("/store/")[1].split("/")[0]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    two = store.append(again)
    for name in ("observations", "rejected"):
        assert "Join LeftAnti" not in plans[name] and "Join LeftSemi" not in plans[name], plans[name]
        assert "store/observations" not in plans[name]
    assert plans["observations"].count("Join Inner") == 2  # rounds and settlements
    assert two.accepted == flat.where("round_id >= 4").count() and two.accepted + two.rejected == again.count()
    reasons = {r["reason"]: r["count"] for r in store.rejected().groupBy("reason").count().collect()}
    assert reasons == {"already loaded": flat.where("round_id IN (2, 3)").count() + 2, "repeated": 2}


def test_an_empty_load(spark, panel, tmp_path):
    store = FlatStore(spark, str(tmp_path / "store"))
    assert store.loads().count() == store.observations().count() == store.rejected().count() == 0
    load = store.append(flat_of(panel).where("false"))
    assert (load.accepted, load.rejected) == (0, 0) and store.tables().observations.count() == 0


# ── stored views ──


def test_bitmaps_count_what_count_distinct_counts(spark, panel):
    rows = panel.observations.withColumn("part", F.col("settlement_id") % 3)
    rows = rows.unionByName(rows.limit(50)).unionByName(rows.limit(5).withColumn("settlement_id", F.lit(None).cast("long")))
    rows = rows.unionByName(rows.limit(9).withColumn("settlement_id", F.col("settlement_id") * 40_000))
    bits = unit_bitmaps(rows, ["round_id", "part"], "settlement_id")
    for keys in (["round_id", "part"], ["part"], ["round_id"], []):
        want = rows.groupBy(*keys).agg(F.countDistinct("settlement_id").alias("n")).where("n > 0")
        assert rows_of(distinct_units(bits, keys, "n")) == rows_of(want)


def test_only_the_changed_round_is_rewritten(spark, panel, tmp_path):
    store = ViewStore(spark, str(tmp_path / "views"))
    assert store.refresh(panel) == [1, 2, 3, 4, 5, 6]
    files = lambda: {str(p): p for p in (tmp_path / "views").rglob("*.parquet") if "round_id=" in str(p)}
    before = files()
    assert store.refresh(panel) == [] and files().keys() == before.keys()
    changed = panel.observations.withColumn("idp_arrivals", F.when(F.col("round_id") == 3, F.col("idp_arrivals") + 1).otherwise(F.col("idp_arrivals")))
    t = panel.with_observations(changed)
    assert store.refresh(t) == [3]
    after = files()
    assert {p.parent.name for n, p in after.items() if n not in before} == {"round_id=3"}
    assert {p.parent.name for n, p in before.items() if n not in after} == {"round_id=3"}
    assert rows_of(store.province_summary(t)) == rows_of(VIEWS["vw_province_summary"](t))
    assert rows_of(store.national_dashboard(t)) == rows_of(VIEWS["vw_national_dashboard"](t))
    assert rows_of(store.province_burden(t)) == rows_of(REPORTS["q2a_province_burden"](t))
    assert rows_of(store.top_provinces(t, 6, 10)) == rows_of(REPORTS["s1_top_provinces"](t))
    # A round that goes is no longer read; one without a label stays in the totals over all rounds.
    fewer = panel.with_observations(panel.observations.where("round_id <> 2"))
    assert store.refresh(fewer) == [3]
    assert rows_of(store.national_dashboard(fewer)) == rows_of(VIEWS["vw_national_dashboard"](fewer))
    assert rows_of(store.province_burden(fewer)) == rows_of(REPORTS["q2a_province_burden"](fewer))


def test_a_settlement_that_moves_changes_its_rounds(spark, panel, tmp_path):
    store = ViewStore(spark, str(tmp_path / "views"))
    store.refresh(panel)
    moved = panel.settlements.withColumn("adm2_code", F.when(F.col("settlement_id") == 101, "P0301").otherwise(F.col("adm2_code")))
    t = Tables(panel.provinces, panel.districts, moved, panel.survey_rounds, panel.observations)
    assert store.refresh(t) == [1, 2, 3, 4, 5, 6]
    assert rows_of(store.province_summary(t)) == rows_of(VIEWS["vw_province_summary"](t))


def test_views_that_exist_stay_unless_replaced(spark, panel):
    fewer = panel.with_observations(panel.observations.where("round_id = 1"))
    register_views(fewer)
    assert register_views(panel, replace=False) == []
    assert spark.table("vw_national_dashboard").count() == 1
    spark.catalog.dropTempView("vw_national_dashboard")
    assert register_views(panel, replace=False) == ["vw_national_dashboard"]
    assert spark.table("vw_national_dashboard").count() == 6 and spark.table("observations").select("round_id").distinct().count() == 1
    assert len(register_views(panel)) == 10 and spark.table("vw_province_summary").select("round_id").distinct().count() == 6
