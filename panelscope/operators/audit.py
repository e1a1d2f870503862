"""Data-quality audits: row counts, panel balance, coverage, NULL audits, distributions,
numeric summaries, flag shares, and the declared constraints (NOT NULL, PK/UNIQUE, FK,
value domains) checked as distributed jobs instead of being enforced on write.

Wide audits are a single aggregation over the table followed by an unpivot, so a table
is scanned once however many columns are audited.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.expr import count_where, label_levels, pct, round_half_up, safe_div
from panelscope.operators.stats import kth_value
from panelscope.sources import schema as S
from panelscope.sources.tables import Tables


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each table."""
    return _union(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )


def null_audit(df: DataFrame, cols: Mapping[str, str], total: str = "total_rows") -> DataFrame:
    """One row: COUNT(*) and, per column, the number of NULLs (output name -> column)."""
    return df.agg(
        F.count(F.lit(1)).alias(total), *[count_where(F.col(c).isNull()).alias(name) for name, c in cols.items()]
    )


def null_audit_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Per group: total rows, NULL rows of ``col`` and their percentage (1 dp)."""
    nulls = count_where(F.col(col).isNull())
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        nulls.alias("null_change"),
        round_half_up(safe_div(nulls.cast("double") * F.lit(100.0), F.count(F.lit(1))), 1).alias("pct_null"),
    )


def distribution(df: DataFrame, col: str, labels: Mapping[int, str], digits: int = 2) -> DataFrame:
    """Frequency of each value of ``col`` (NULL is its own group, with a NULL label) and its
    percentage of all rows. The denominator is the sum of the frequencies, i.e. COUNT(*)
    of the table, a window over the aggregated frame (one row per level), so the table is
    scanned once."""
    freq = df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("frequency"))
    total = F.sum("frequency").over(Window.partitionBy())
    return freq.select(
        "level",
        label_levels("level", labels).alias("label"),
        "frequency",
        round_half_up(safe_div(F.col("frequency").cast("double") * F.lit(100.0), total), digits).alias("pct"),
    )


def numeric_summary(df: DataFrame, col: str, where: Column | None = None, median_over_all: bool = True) -> DataFrame:
    """MIN, MAX, AVG (1 dp) of ``col`` over rows matching ``where``, and the positional
    upper median (value at offset COUNT(*) div 2, NULLs first). The median is taken over
    all rows of ``df`` when ``median_over_all`` (the reference report's scope)."""
    sel = df.where(where) if where is not None else df
    med = kth_value(df if median_over_all else sel, col, out="median")
    return sel.agg(
        F.min(col).alias("min_arrivals"),
        F.max(col).alias("max_arrivals"),
        round_half_up(F.avg(col), 1).alias("avg_arrivals"),
    ).select("*", med.scalar().alias("median_arrivals"))


def flag_shares(df: DataFrame, flags: Mapping[str, str], digits: int = 2, name: str = "aid_type", value: str = "pct_delivered") -> DataFrame:
    """Percent of rows with each 0/1 flag set, as (label, percent) rows: one scan, one
    aggregation, then an unpivot."""
    wide = df.agg(*[pct(c, digits).alias(label) for label, c in flags.items()])
    return wide.unpivot([], list(flags.keys()), name, value)


def check_not_null(df: DataFrame, cols: Sequence[str], table: str) -> DataFrame:
    """(table_name, column_name, null_rows) for each declared NOT NULL column."""
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "null_rows").select(
        F.lit(table).alias("table_name"), "column_name", "null_rows"
    )


def check_unique(df: DataFrame, cols: Sequence[str], table: str) -> DataFrame:
    """(table_name, key_columns, duplicate_keys, duplicate_rows): key values occurring more
    than once and the rows carrying them. Keys with a NULL part are ignored (UNIQUE)."""
    keyed = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 0) if len(cols) > 1 else df.where(
        F.col(cols[0]).isNotNull()
    )
    dup = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.agg(
        F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows")
    ).select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "duplicate_keys", "duplicate_rows")


def check_fk(child: DataFrame, col: str, parent: DataFrame, pcol: str, names: tuple[str, str]) -> DataFrame:
    """(child_table, child_column, parent_table, orphan_rows): child rows whose non-NULL key
    has no parent (left anti join; Spark broadcasts the parent when it is small)."""
    keys = parent.select(F.col(pcol).alias(col)).distinct()
    orphans = child.where(F.col(col).isNotNull()).select(col).join(keys, col, "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("orphan_rows")).select(
        F.lit(names[0]).alias("child_table"), F.lit(col).alias("child_column"), F.lit(names[1]).alias("parent_table"), "orphan_rows"
    )


def check_range(df: DataFrame, domains: Mapping[str, tuple[int, int]], table: str) -> DataFrame:
    """(table_name, column_name, low, high, out_of_range) per column; NULLs pass."""
    wide = df.agg(
        *[F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(c) for c, (lo, hi) in domains.items()]
    )
    bounds = F.create_map(*[x for c, (lo, hi) in domains.items() for x in (F.lit(c), F.array(F.lit(lo), F.lit(hi)))])
    return (
        wide.unpivot([], list(domains.keys()), "column_name", "out_of_range")
        .withColumn("_b", bounds[F.col("column_name")])
        .select(
            F.lit(table).alias("table_name"),
            "column_name",
            F.col("_b")[0].cast("int").alias("low"),
            F.col("_b")[1].cast("int").alias("high"),
            "out_of_range",
        )
    )


def unbalanced_units(
    obs: DataFrame, rounds: DataFrame, unit: str = "settlement_id", period: str = "round_id"
) -> DataFrame:
    """Units observed in fewer distinct periods than the period table holds:
    (unit, periods_observed, periods_expected)."""
    expected = rounds.agg(F.countDistinct(period)).scalar()
    return (
        obs.groupBy(unit)
        .agg(F.countDistinct(period).alias("periods_observed"))
        .where(F.col("periods_observed") < expected)
        .select(unit, "periods_observed", expected.alias("periods_expected"))
    )


# Declared-constraint audits over all five tables.


def audit_not_null(t: Tables) -> DataFrame:
    return _union([check_not_null(t[n], S.not_null_columns(n), n) for n in S.TABLE_NAMES])


def audit_unique(t: Tables) -> DataFrame:
    checks = [check_unique(t[n], cols, n) for n, cols in S.PRIMARY_KEYS.items()]
    checks += [check_unique(t[n], cols, n) for n, keys in S.UNIQUE_KEYS.items() for cols in keys]
    return _union(checks)


def audit_fk(t: Tables) -> DataFrame:
    return _union([check_fk(t[c], cc, t[p], pc, (c, p)) for c, cc, p, pc in S.FOREIGN_KEYS])


def audit_domains(t: Tables) -> DataFrame:
    return check_range(t.observations, S.DOMAINS, "observations")
