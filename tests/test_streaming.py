"""Rounds arriving as files in two waves; the streamed dashboard equals the batch view."""

from pyspark.sql import functions as F

import fixtures
from panelscope.plans.views import v4_national_dashboard
from panelscope.sources import load_tables
from panelscope.sources.schema import OBSERVATIONS
from panelscope.streaming import start_round_ingest
from panelscope.streaming.rounds import read_fact


def test_round_ingest_matches_batch_dashboard(spark, tmp_path):
    base = fixtures.build(spark, str(tmp_path / "base"))
    t = load_tables(spark, base)
    src, fact, dash = str(tmp_path / "src"), str(tmp_path / "fact"), str(tmp_path / "dash")
    obs = t.observations

    # Wave 1: rounds 1-3 plus half of round 4; wave 2: the rest of round 4 and rounds 5-6.
    w1 = obs.where((F.col("round_id") <= 3) | ((F.col("round_id") == 4) & (F.col("settlement_id") % 2 == 0)))
    w2 = obs.subtract(w1)
    w1.write.mode("append").parquet(src)
    q = start_round_ingest(spark, src, fact, dash, t, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    partial = spark.read.parquet(dash)
    assert sorted(r.round_id for r in partial.select("round_id").collect()) == [1, 2, 3, 4]

    w2.write.mode("append").parquet(src)
    q = start_round_ingest(spark, src, fact, dash, t, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()

    got = spark.read.parquet(dash)
    want = v4_national_dashboard(t)
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    stored = read_fact(spark, fact)
    assert stored.count() == obs.count()
    assert stored.schema == obs.select(*OBSERVATIONS.fieldNames()).schema
