"""Operators against brute force on small inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.functions.expr import int_div, label_levels, round_half_up, safe_div, tier
from panelscope.operators.panel import moving_avg, period_compare, period_delta, running_total
from panelscope.operators.rank import rank_in, rank_rows, top_n_per
from panelscope.operators.stats import kth_value


def test_round_half_up_on_decimal_value(spark):
    df = spark.createDataFrame([(23, 40, 2), (323, 80, 3), (1, 8, 2), (-1, 8, 2), (5, 2, 0)], "a long, b long, d int")
    got = [
        r[0]
        for r in df.select(
            F.when(F.col("d") == 2, round_half_up(F.col("a") / F.col("b"), 2))
            .when(F.col("d") == 3, round_half_up(F.col("a") / F.col("b"), 3))
            .otherwise(round_half_up(F.col("a") / F.col("b"), 0))
        ).collect()
    ]
    assert got == [0.58, 4.038, 0.13, -0.13, 3.0]
    assert df.select(round_half_up(F.col("a") / F.col("b"), 2)).schema.fields[0].dataType.simpleString() == "double"


def test_safe_and_integer_division(spark):
    df = spark.createDataFrame([(250, 100), (-250, 100), (7, 0), (None, 3)], "a long, b long")
    rows = df.select(int_div("a", "b").alias("q"), safe_div("a", "b").alias("r")).collect()
    assert [r.q for r in rows] == [2, -2, None, None]
    assert [r.r for r in rows] == [2.5, -2.5, None, None]


def test_labels_and_tiers(spark):
    df = spark.createDataFrame([(0,), (5,), (9,), (None,)], "v int")
    assert [r[0] for r in df.select(label_levels("v", {0: "zero", 5: "five"})).collect()] == ["zero", "five", None, None]
    df = spark.createDataFrame([(0.7,), (0.69,), (None,)], "v double")
    assert [r[0] for r in df.select(tier("v", [(0.7, "hi"), (0.4, "mid")], "low")).collect()] == ["hi", "mid", "low"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_in_equals_window_rank(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), rng.randint(1, 2), rng.choice([None, 0, 5, 5, 7, 9, 12]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, r int, v long, id long")
    want = df.withColumn("rank", F.rank().over(Window.partitionBy("g", "r").orderBy(F.col("v").desc())).cast("long"))
    got = rank_in(df, ["g", "r"], "v")
    assert sorted(map(tuple, got.select("id", "rank").collect())) == sorted(map(tuple, want.select("id", "rank").collect()))
    want_asc = df.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").asc())).cast("long"))
    got_asc = rank_in(df, ["g"], "v", desc=False)
    assert sorted(map(tuple, got_asc.select("id", "rank").collect())) == sorted(
        map(tuple, want_asc.select("id", "rank").collect())
    )
    some = df.where(F.col("id") % 17 == 0)
    got_rows = rank_rows(some, df, ["g", "r"], "v")
    want_rows = want.where(F.col("id") % 17 == 0)
    assert sorted(map(tuple, got_rows.select("id", "rank").collect())) == sorted(
        map(tuple, want_rows.select("id", "rank").collect())
    )


@pytest.mark.parametrize(
    "values",
    [
        [None, 0, 7, 149, 250, 1000],  # positional upper median: 149
        [None, None, None, None, 1, 2],  # lands on a NULL
        [],
        [5],
        [3, 3, 3, 3],
        [10**12, -(10**12), 0, 17, 17, 18, None],
    ],
)
def test_kth_value_equals_sorted_position(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, key=lambda x: (x is not None, x if x is not None else 0))
    k = len(values) // 2
    want = ordered[k] if k < len(ordered) else None
    got = kth_value(df, "v", out="m").collect()
    assert len(got) == 1 and got[0].m == want


def test_kth_value_dense_random(spark):
    rng = random.Random(5)
    vals = [rng.randint(-5000, 5000) for _ in range(3000)] + [None] * 40
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    ordered = sorted(vals, key=lambda x: (x is not None, x if x is not None else 0))
    assert kth_value(df, "v", buckets=16).collect()[0].value == ordered[len(vals) // 2]


def test_panel_windows(spark):
    rows = [(1, r, v) for r, v in [(1, 10), (2, None), (3, 30), (5, 50)]] + [(2, 1, 0), (2, 2, 5)]
    df = spark.createDataFrame(rows, "u long, p int, v long")
    out = period_delta(df, "v", "p", unit="u", prev="prev", delta="d", pct="pct")
    out = running_total(out, "u", "p", "v", "cum")
    out = moving_avg(out, "u", "p", "v", 3, "ma", digits=2)
    got = {(r.u, r.p): (r.prev, r.d, r.pct, r.cum, r.ma) for r in out.collect()}
    assert got[(1, 1)] == (None, None, None, 10, 10.0)
    assert got[(1, 3)] == (None, None, None, 40, 20.0)
    assert got[(1, 5)] == (30, 20, 66.67, 90, 40.0)
    assert got[(2, 2)] == (0, 5, None, 5, 2.5)


def test_period_compare_requires_both_periods(spark):
    rows = [(1, 1, 5), (1, 6, 9), (2, 1, 3), (3, 6, 4)]
    df = spark.createDataFrame(rows, "u long, p int, v long")
    got = sorted(map(tuple, period_compare(df, "u", "p", 1, 6, {"v": "x"}).collect()))
    assert got == [(1, 5, 9)]


def test_top_n_per_plans_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("v"), "id")
    out = top_n_per(df, ["g"], [F.col("v").desc(), F.col("id")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == 6


def test_lead_mirrors_lag(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 4, 5), (2, 1, 7)], "u long, p int, v long")
    got = {(r.u, r.p): r.nxt for r in period_delta(df, "v", "p", unit="u", prev="nxt", direction="lead").collect()}
    assert got == {(1, 1): 20, (1, 2): 5, (1, 4): None, (2, 1): None}


def test_persistent_counts_periods(spark):
    from panelscope.operators.aggregate import persistent

    rows = [(1, r, 5) for r in (1, 2, 3)] + [(2, 1, 5), (2, 2, 0), (2, 3, 5)] + [(3, 1, 5), (3, 1, 5), (3, 2, 5)]
    df = spark.createDataFrame(rows, "u long, p int, v long")
    got = sorted(map(tuple, persistent(df, "u", "p", F.col("v") > 1, 3, F.sum("v").alias("s")).collect()))
    assert got == [(1, 3, 15), (3, 3, 15)]  # COUNT(period) counts rows, as the report does
    got = sorted(map(tuple, persistent(df, "u", "p", F.col("v") > 1, 3, distinct=True).collect()))
    assert got == [(1, 3)]


@pytest.mark.parametrize("seed", [11, 12])
def test_unit_scan_equals_plain_windows_with_hot_unit(spark, seed):
    from panelscope.operators.panel import unit_scan

    rng = random.Random(seed)
    rows = []
    oid = 0
    for u in range(30):
        for r in range(1, 7):
            oid += 1
            rows.append((u, r, oid, rng.choice([None, 0, 3, 8, 20])))
    for _ in range(600):  # unit 0: a hot group of copies, a large share of all rows
        oid += 1
        rows.append((0, rng.randint(1, 6), oid, rng.choice([None, 1, 2, 5])))
    df = spark.createDataFrame(rows, "u long, r int, oid long, v long")
    w = Window.partitionBy("u").orderBy("r", "oid")
    want = df.select(
        "oid",
        F.lag("v").over(w).alias("p"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("c"),
    )
    got = unit_scan(df, "u", ["r", "oid"], "v", prev="p", cum="c", partitions=7).select("oid", "p", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # with further columns, and without reuse of exchanges, every row is there and right
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        wide = unit_scan(df.withColumn("more", F.lit("x")), "u", ["r", "oid"], "v", prev="p", cum="c", partitions=64)
        assert sorted(map(tuple, wide.select("oid", "p", "c").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_kth_value_with_an_outlier_reads_few_counts(spark, monkeypatch):
    from panelscope.operators import stats

    rows = [(v,) for v in range(5000)] + [(10**12,), (None,)]
    df = spark.createDataFrame(rows, "v long")
    steps = []
    narrowed = stats._narrowed
    monkeypatch.setattr(stats, "_narrowed", lambda *a: steps.append(a) or narrowed(*a))
    assert kth_value(df, "v", out="m").first().m == 2500
    assert len(steps) <= 4
    plan = kth_value(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert kth_value(spark.createDataFrame([(x,) for x in (0.5, 1e300, -1e300, 2.5, 1e-300)], "v double"), "v", k=2).first()[0] == 0.5


def test_int_div_is_exact_beyond_doubles(spark):
    from panelscope.functions.expr import int_div

    row = spark.createDataFrame([(90071992547409937, -7, 0)], "a long, b long, z long").select(
        int_div("a", 10).alias("x"), int_div("b", 2).alias("y"), int_div("a", "z").alias("n")
    ).first()
    assert tuple(row) == (9007199254740993, -3, None)


def test_kth_value_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(
        st.lists(st.one_of(st.none(), st.integers(-(10**6), 10**6), st.sampled_from([0, 7, 7, 7])), max_size=60),
        st.integers(0, 70),
        st.sampled_from([1, 4, 1024]),
    )
    def check(values, k, buckets):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        kdf = spark.createDataFrame([(k,)], "k long")
        ordered = sorted(values, key=lambda x: (x is not None, x if x is not None else 0))
        want = ordered[k] if k < len(ordered) else None
        assert kth_value(df, "v", k=kdf, buckets=buckets).collect()[0].value == want

    check()


@pytest.mark.parametrize("buckets", [1, 2, 3, 16])
def test_rank_in_blocked_equals_window(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.randint(1, 2), rng.choice([None, -50, 0, 0, 0, 3, 3, 40, 41, 999]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v long, id long")
    for desc in (True, False):
        order = F.col("v").desc() if desc else F.col("v").asc()
        want = df.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(order)).cast("long"))
        got = rank_in(df, ["g"], "v", desc=desc, partitions=buckets)
        assert sorted(map(tuple, got.select("id", "rank").collect())) == sorted(
            map(tuple, want.select("id", "rank").collect())
        )
