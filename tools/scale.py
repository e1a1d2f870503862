"""Scaling check: replicate the sf0.1 panel k times (new settlement ids, same geography)
and time every report. ``--hot`` replicates one province 12x more so it holds about a
third of all rows; ``--copies`` duplicates one settlement's rows until they are a third of
the fact (the store's key check then fails and the unbucketed layout is used);
``--eventlog DIR`` writes Spark's event log to a scratch folder and adds per-report task
skew figures.

    python tools/scale.py --k 10 [--hot] [--copies] [--eventlog DIR] [--keys a,b]
Prints one JSON line with per-report seconds.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelscope.plans.reports import REPORTS
from panelscope.sources.binding import tables_for
from panelscope.sources.tables import Tables, load_catalog, scratch_path, write_tables


def add_copies(t: Tables) -> Tables:
    """Duplicate one settlement's rows until the copies are a third of the fact (a hot
    group of copies violating UNIQUE(settlement_id, round_id))."""
    n = t.observations.count()
    base = t.observations.where(F.col("settlement_id") == t.observations.agg(F.min("settlement_id")).first()[0])
    per = max(1, base.count())
    reps = max(1, (n // 2) // per)
    big = t.observations.agg(F.max("observation_id")).first()[0] + 1
    copies = base.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "observation_id", F.col("observation_id") + F.col("_c").cast("long") * F.lit(big).cast("long")
    ).drop("_c")
    return t.with_observations(t.observations.unionByName(copies))


def replicate(t: Tables, k: int, hot: bool) -> Tables:
    span = t.settlements.agg(F.max("settlement_id")).first()[0] + 1
    reps = F.when(F.lit(hot) & F.col("adm2_code").startswith("P00"), 12 * k).otherwise(k)
    s = t.settlements.withColumn("rep", F.explode(F.sequence(F.lit(0), reps - 1)))
    s = s.withColumn("settlement_id", F.col("settlement_id") + F.col("rep") * F.lit(span)).withColumn(
        "settlement_code", F.concat("settlement_code", F.lit("#"), F.col("rep").cast("string"))
    )
    rep_of = s.select(F.col("settlement_id").alias("new_id"), (F.col("settlement_id") % span).alias("settlement_id"))
    o = t.observations.join(rep_of, "settlement_id").withColumn("settlement_id", F.col("new_id")).drop("new_id")
    o = o.withColumn("observation_id", F.col("settlement_id") * 6 + F.col("round_id"))
    return Tables(t.provinces, t.districts, s.drop("rep"), t.survey_rounds, o.select(*t.observations.columns))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--k", type=int, default=10)
    ap.add_argument("--hot", action="store_true")
    ap.add_argument("--copies", action="store_true", help="one settlement duplicated to a third of the fact")
    ap.add_argument("--keys", default="")
    ap.add_argument("--eventlog", default="", help="scratch folder for Spark's event log; prints per-report task skew")
    a = ap.parse_args()
    builder = SparkSession.builder
    if a.eventlog:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.eventlog)
    spark = (
        builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = tables_for(spark, a.sf)
    path = scratch_path(spark, f"scale-k{a.k}{'-hot' if a.hot else ''}{'-copies' if a.copies else ''}")
    t0 = time.perf_counter()
    database = "panelscope_" + path.rsplit("-", 1)[-1]
    panel = replicate(base, a.k, a.hot)
    if a.copies:
        panel = add_copies(panel)
    write_tables(panel, path, buckets=16, database=database)
    prep = time.perf_counter() - t0
    t = load_catalog(spark, database)
    n = t.observations.count()
    keys = [k for k in a.keys.split(",") if k] or list(REPORTS)
    times = {}
    sc = spark.sparkContext
    for key in keys:
        REPORTS[key](t).write.format("noop").mode("overwrite").save()
        sc.setJobDescription(key)
        s = time.perf_counter()
        REPORTS[key](t).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - s, 3)
        sc.setJobDescription(None)
    out = {"k": a.k, "hot": a.hot, "copies": a.copies, "unit_key_bounded": t.unit_key_bounded, "observations": n, "prepare_sec": round(prep, 2),
           "total_sec": round(sum(times.values()), 2), "queries": times}
    if a.eventlog:
        spark.stop()
        out["task_skew"] = task_skew(a.eventlog)
    print(json.dumps(out))


def task_skew(log_dir: str) -> dict:
    """Per report (job description), over its stages with at least 8 tasks: the longest
    task, the largest max/median task-time ratio, and the largest max/mean ratio of
    shuffle-read records per task (1.0 = perfectly even)."""
    import glob
    import statistics

    stage_desc, tasks = {}, {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        if path.endswith(".zstd"):
            import io

            import zstandard

            with open(path, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8").read()
        else:
            with open(path) as f:
                text = f.read()
        if True:
            for line in text.splitlines():
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        if desc:
                            stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
                    rec = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    tasks.setdefault(ev["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"], rec))
    worst = {}
    for sid, ts in tasks.items():
        desc = stage_desc.get(sid)
        if not desc or len(ts) < 8:
            continue
        durs = [d for d, _ in ts]
        recs = [r for _, r in ts]
        w = worst.setdefault(desc, {"max_task_ms": 0, "time_max_over_median": 0.0, "shuffle_max_over_mean": 0.0})
        w["max_task_ms"] = max(w["max_task_ms"], max(durs))
        w["time_max_over_median"] = max(w["time_max_over_median"], round(max(durs) / max(1.0, statistics.median(durs)), 2))
        if sum(recs):
            w["shuffle_max_over_mean"] = max(w["shuffle_max_over_mean"], round(max(recs) / (sum(recs) / len(recs)), 2))
    return worst


if __name__ == "__main__":
    main()
