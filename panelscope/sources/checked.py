"""Loading CSV seed files with a reject table: good rows come back typed and consistent, every
other line is kept with the rule it breaks, and the two add up to all lines of the files.

A line is turned away by the first of these rules, in this order:

* ``malformed line``: too few or too many fields;
* ``not a <type>: <column>``: a value that doesn't read as the declared type;
* ``missing: <column>``: no value in a NOT NULL column;
* ``out of range: <column>``: outside the column's declared domain;
* ``orphan: <column>``: its parent is not among the accepted rows of the table it refers to
  (tables are checked parents first, so a rejected parent's children are turned away as well);
* ``repeated: <columns>``: a primary or unique key that another accepted row holds. The smallest
  row of a key, by its columns, stays; the result doesn't depend on the order of lines.

Headers must match the declared columns: another file under a table's name is an error, not
rows to reject. An empty field is NULL. Each file is scanned once: casts and row rules are one
projection, whose result is written to the shared checkpoint folder for the key checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.sources.rejects import split_repeats
from panelscope.sources.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, not_null_columns
from panelscope.sources.tables import Tables, broadcast_if_small, scratch_path

LOAD_ORDER = ["provinces", "districts", "settlements", "survey_rounds", "observations"]  # parents first
BAD_LINE = "_corrupt_record"
REJECTED = "table_name string, rule string, line string"


@dataclass
class CheckedLoad:
    """``tables``: the accepted rows. ``rejected``: table_name, rule, line (the line's fields as
    JSON by column, or a malformed line as it is)."""

    tables: Tables
    rejected: DataFrame


def _row_rule(table: str, columns: T.StructType) -> Column:
    """The first broken rule that a row shows by itself; NULL when it breaks none."""
    rules = [F.when(F.col(BAD_LINE).isNotNull(), F.lit("malformed line"))]
    for f in columns:
        unread = F.col(f"raw.{f.name}").isNotNull() & F.col(f"row.{f.name}").isNull()
        rules.append(F.when(unread, F.lit(f"not a {f.dataType.simpleString()}: {f.name}")))
    rules += [F.when(F.col(f"row.{c}").isNull(), F.lit(f"missing: {c}")) for c in not_null_columns(table)]
    for c, (low, high) in DOMAINS.items():
        if c in columns.fieldNames():
            rules.append(F.when(~F.col(f"row.{c}").between(low, high), F.lit(f"out of range: {c}")))
    return F.coalesce(*rules)


def _staged(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The file's lines once: row (typed), rule, line."""
    columns = SCHEMAS[table]
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in columns] + [T.StructField(BAD_LINE, T.StringType())])
    read = (
        spark.read.schema(raw)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .csv(f"{path}/{table}.csv")
    )
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.dataType != T.StringType() else F.col(f.name) for f in columns]
    rows = read.select(F.struct(*columns.fieldNames()).alias("raw"), F.struct(*typed).alias("row"), BAD_LINE)
    line = F.coalesce(F.col(BAD_LINE), F.to_json("raw"))
    out = scratch_path(spark, f"staged-{table}")
    rows.select("row", _row_rule(table, columns).alias("rule"), line.alias("line")).write.parquet(out)
    return spark.read.parquet(out)


def _turned_away(table: str, rows: DataFrame, rule) -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), rule.alias("rule"), "line")


def load_checked(spark: SparkSession, path: str) -> CheckedLoad:
    """Read ``{path}/{table}.csv`` of the five tables (see the module)."""
    good: dict[str, DataFrame] = {}
    rejected = []
    for table in LOAD_ORDER:
        staged = _staged(spark, path, table)
        rejected.append(_turned_away(table, staged.where("rule IS NOT NULL"), F.col("rule")))
        rows = staged.where("rule IS NULL").select("row.*", "line")
        for child, column, parent, key in FOREIGN_KEYS:
            if child == table:
                known = broadcast_if_small(good[parent].select(F.col(key).alias(column)).distinct())
                rejected.append(_turned_away(table, rows.join(known, column, "left_anti"), F.lit(f"orphan: {column}")))
                rows = rows.join(known, column, "left_semi")
        for keys in [PRIMARY_KEYS[table], *UNIQUE_KEYS.get(table, [])]:
            rows, surplus = split_repeats(rows, keys)
            rejected.append(_turned_away(table, surplus, F.lit(f"repeated: {','.join(keys)}")))
        out = scratch_path(spark, f"accepted-{table}")
        rows.select(*SCHEMAS[table].fieldNames()).write.parquet(out)
        good[table] = spark.read.schema(SCHEMAS[table]).parquet(out)
    every = spark.createDataFrame([], REJECTED)
    for frame in rejected:
        every = every.unionByName(frame)
    out = scratch_path(spark, "rejected")
    every.write.parquet(out)
    return CheckedLoad(Tables(**good), spark.read.parquet(out))
