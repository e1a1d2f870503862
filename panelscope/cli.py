"""Run reports over stored tables and write each result (the result sink).

    python -m panelscope.cli --tables /data/panel [--format parquet|csv|catalog:<db>]
        --out /data/reports [--reports q1a_idp_by_round,v4_national_dashboard]
        [--write-format parquet|csv]

Each report is written to ``{out}/{key}``; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from panelscope.plans.reports import REPORTS
from panelscope.sources.tables import load_catalog, load_tables


def run(spark: SparkSession, tables: str, fmt: str, out: str, keys: list[str], write_format: str = "parquet") -> None:
    t = load_catalog(spark, fmt.split(":", 1)[1]) if fmt.startswith("catalog:") else load_tables(spark, tables, fmt)
    for key in keys:
        w = REPORTS[key](t).write.mode("overwrite").format(write_format)
        if write_format == "csv":
            w = w.option("header", True)
        w.save(f"{out}/{key}")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="panelscope")
    ap.add_argument("--tables", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--reports", default="")
    ap.add_argument("--write-format", default="parquet")
    a = ap.parse_args(argv)
    keys = [k for k in a.reports.split(",") if k] or list(REPORTS)
    unknown = sorted(set(keys) - set(REPORTS))
    if unknown:
        ap.error(f"unknown reports: {', '.join(unknown)}")
    spark = SparkSession.builder.appName("panelscope").getOrCreate()
    run(spark, a.tables, a.format, a.out, keys, a.write_format)


if __name__ == "__main__":
    main()
