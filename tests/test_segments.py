"""Segmented scans, frames, ranks and medians against plain windows on small frames with hot
units, short segments, ties, NULLs and repeated rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.operators.panel import moving_avg, period_delta, unit_frame, unit_scan
from panelscope.operators.rank import ntile_from, percent_rank_from, positions
from panelscope.operators.stats import kth_in, kth_value

ROWS = "unit long, period int, id long, v long"


def hot_rows(seed, n=240):
    """A third of the rows belong to unit 1; some units and periods are null; v has ties and nulls."""
    random.seed(seed)
    rows = []
    for i in range(n):
        unit = 1 if i % 3 == 0 else random.choice([2, 3, 4, 5, 6, 7, 8, None])
        rows.append((unit, random.choice([1, 2, 3, 4, 5, 6, None]), i, random.choice([None, 0, 0, 0, 5, random.randrange(-50, 50)])))
    random.shuffle(rows)
    return rows


def listed(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 40, 150])
def test_lead_and_lag_cross_segments(spark, partitions):
    df = spark.createDataFrame(hot_rows(partitions), ROWS)
    w = Window.partitionBy("unit").orderBy("period", "id")
    want = df.select("id", F.lag("v").over(w), F.lead("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = unit_scan(df, "unit", ["period", "id"], "v", prev="a", next="b", cum="c", partitions=partitions)
    assert got.columns == [*df.columns, "a", "b", "c"]
    assert listed(got, "id", "a", "b", "c") == listed(want)


def test_lead_by_period_delta_segmented(spark):
    df = spark.createDataFrame(hot_rows(9), ROWS)
    args = dict(measure="v", period="period", unit="unit", prev="next_v", delta="d", pct="p", direction="lead", tiebreak="id")
    assert listed(period_delta(df, **args, segmented=True), "id", "next_v", "d", "p") == listed(period_delta(df, **args), "id", "next_v", "d", "p")


@pytest.mark.parametrize("partitions,before,after", [(1, 2, 0), (3, 2, 0), (40, 4, 0), (150, 5, 0), (60, 3, 2), (60, 0, 3), (5, 0, 0)])
def test_frames_reach_over_short_segments(spark, partitions, before, after):
    df = spark.createDataFrame(hot_rows(partitions + before), ROWS)
    w = Window.partitionBy("unit").orderBy("period", "id").rowsBetween(-before, after)
    want = df.select("id", F.avg("v").over(w), F.max("v").over(w), F.count("v").over(w))
    got = unit_frame(df, "unit", ["period", "id"], "v", {"a": F.avg, "m": F.max, "n": F.count}, before, after, partitions)
    assert got.columns == [*df.columns, "a", "m", "n"]
    assert listed(got, "id", "a", "m", "n") == listed(want)


def test_frames_of_several_unit_columns_and_no_rows(spark):
    df = spark.createDataFrame(hot_rows(2), ROWS).withColumn("part", F.col("id") % 2)
    w = Window.partitionBy("unit", "part").orderBy("period", "id").rowsBetween(-2, 0)
    want = df.select("id", F.sum("v").over(w))
    assert listed(unit_frame(df, ["unit", "part"], ["period", "id"], "v", {"s": F.sum}, 2, partitions=50), "id", "s") == listed(want)
    assert unit_frame(df.where("false"), "unit", ["period", "id"], "v", {"s": F.sum}, 2).count() == 0


def test_moving_average_keeps_null_rules(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, 4), (1, 3, 3, None), (1, 4, 4, None), (1, 5, 5, None)], ROWS)
    want = [(1, None), (2, 4.0), (3, 4.0), (4, 4.0), (5, None)]
    for segmented in (False, True):
        assert listed(moving_avg(df, "unit", "period", "v", 3, "m", digits=2, tiebreak="id", segmented=segmented), "id", "m") == want


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("partitions", [1, 4, 60])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_positions_give_every_ranking_function(spark, desc, partitions, kind):
    df = spark.createDataFrame(hot_rows(partitions), ROWS).withColumn("v", F.col("v").cast(kind))
    down = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
    back = F.col("v").asc_nulls_first() if desc else F.col("v").desc_nulls_last()
    for group in ([], ["unit"]):
        w, r = Window.partitionBy(*group).orderBy(down), Window.partitionBy(*group).orderBy(back)
        line = Window.partitionBy(*group).orderBy(down, "id")
        want = df.select(
            "id",
            F.row_number().over(line),
            F.rank().over(w),
            *[F.ntile(n).over(line) for n in (4, 7, 500)],
            F.percent_rank().over(w),
            F.percent_rank().over(r),
            F.count(F.lit(1)).over(Window.partitionBy(*group)),
        )
        got = positions(df, "v", "id", group, desc, partitions)
        assert got.columns == [*df.columns, *[c for c in got.columns if c in ("n_rows", "row_no", "first_row", "last_row")]]
        shown = got.select("id", "row_no", "first_row", *[ntile_from(n) for n in (4, 7, 500)], percent_rank_from(), percent_rank_from(reverse=True), "n_rows")
        assert listed(shown) == listed(want)


def test_one_value_over_many_segments_and_extreme_numbers(spark):
    rows = [(1, 1, i, 7 if 5 < i < 90 else i) for i in range(100)] + [(1, 1, 200, -(2**63)), (1, 1, 201, 2**63 - 1)]
    df = spark.createDataFrame(rows, ROWS)
    want = df.select("id", F.rank().over(Window.orderBy(F.desc("v"))))
    got = positions(df, "v", "id", partitions=40)
    assert listed(got, "id", "first_row") == listed(want)
    assert positions(df.where("false"), "v", "id").count() == 0
    one = positions(df.where("id = 3"), "v", "id").select(percent_rank_from(), ntile_from(4)).first()
    assert tuple(one) == (0.0, 1)


def test_ranks_hold_no_window_in_a_single_task(spark):
    df = spark.createDataFrame(hot_rows(1), ROWS)
    plan = positions(df, "v", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    # Windows over rows are partitioned by their segment; the others run over the segment table.
    for line in plan.splitlines():
        if "Window [" in line and "_seg#" not in line.split("], [", 1)[-1]:
            assert "_size" in line or "_begins" in line or "_ends" in line or "_high" in line, line


@pytest.mark.parametrize("blocks", [2, 1024])
def test_medians_of_all_groups(spark, blocks):
    rows = hot_rows(5, 400) + [(20, 1, 1000, None), (21, 1, 1001, None), (21, 1, 1002, 4), (22, 1, 1003, 10**15), (22, 1, 1004, 1), (22, 1, 1005, 2)]
    df = spark.createDataFrame(rows, ROWS)
    w = Window.partitionBy("unit").orderBy(F.col("v").asc_nulls_first(), "id")
    placed = df.withColumn("nth", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    want = listed(placed.where("nth = n div 2"), "unit", "v")
    assert listed(kth_in(df, ["unit"], "v", blocks=blocks, partitions=9), "unit", "value") == want
    last = listed(placed.where("nth = n - 1"), "unit", "v")
    assert listed(kth_in(df, ["unit"], "v", F.col("n_rows") - 1, blocks=blocks), "unit", "value") == last
    assert {r[1] for r in listed(kth_in(df, ["unit"], "v", F.col("n_rows")), "unit", "value")} == {None}
    assert kth_in(df, [], "v").first()[0] == kth_value(df, "v").first()[0]
    assert kth_in(df.where("false"), ["unit"], "v").count() == 0


def test_medians_of_doubles_and_of_two_keys(spark):
    df = spark.createDataFrame(hot_rows(6, 300), ROWS).withColumn("x", F.col("v") / 7 + F.col("id") / 1e9)
    w = Window.partitionBy("unit", "period").orderBy(F.col("x").asc_nulls_first(), "id")
    placed = df.withColumn("nth", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unit", "period")))
    want = listed(placed.where("nth = n div 2"), "unit", "period", "x")
    assert listed(kth_in(df, ["unit", "period"], "x", out="m", blocks=4), "unit", "period", "m") == want


def test_a_hot_group_is_aggregated_before_it_is_shuffled(spark):
    """50,000 rows of one group leave at most blocks + values rows to shuffle per task."""
    df = spark.range(50_000).select((F.col("id") % 3 * 0).alias("g"), (F.col("id") % 5000).alias("v"))
    assert kth_in(df, ["g"], "v", blocks=64).first()[1] == 2500
