"""The five canonical tables: loading, the Parquet layout writer, and size-checked
broadcasts of the dimension tables.

At scale the fact table (``observations``) is the only large input; ``settlements`` is a
sixth of it (one row per unit, six rounds). ``provinces``, ``districts`` and
``survey_rounds`` are geography/time dimensions whose row counts do not grow with the
panel. Broadcast decisions are still made from counted row numbers (``Tables.rows``),
never assumed: a side is broadcast only when its counted size is under a limit, and
otherwise joined by shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.sources.schema import SCHEMAS, TABLE_NAMES

# Row limits under which a table may be broadcast (checked against counted rows).
# Geo keys are three longs per settlement: 2M rows stay under ~100 MB. Label frames
# (settlement codes, names, coordinates) are wider and get a quarter of that.
DIM_BROADCAST_MAX_ROWS = 1_000_000
GEO_BROADCAST_MAX_ROWS = 2_000_000
LABEL_BROADCAST_MAX_ROWS = 500_000
UNIT_KEY_PROPERTY = "panelscope.unit_key_bounded"
ROWS_PER_FILE = 5_000_000  # of the range-partitioned layout


@dataclass
class Tables:
    provinces: DataFrame
    districts: DataFrame
    settlements: DataFrame
    survey_rounds: DataFrame
    observations: DataFrame
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    # Materialised settlement_id -> district_id, province_id map (see write_tables); when
    # absent it is derived from the three dimension tables on use.
    geo: DataFrame | None = field(default=None, repr=False)
    # False when the writer found a settlement that fills a bucket by itself (a hot group of
    # copies): per-settlement scans then use the segmented form (operators.panel.unit_scan).
    # It chooses a plan only, results are the same; other facts start without it.
    unit_key_bounded: bool | None = field(default=None, repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def rows(self, name: str) -> int:
        """Counted row number of a table (cached). On Parquet this reads footers only."""
        if name not in self._rows:
            self._rows[name] = self[name].count()
        return self._rows[name]

    def small(self, name: str, limit: int = DIM_BROADCAST_MAX_ROWS) -> DataFrame:
        """The table, with a broadcast hint only when its counted size is under ``limit``."""
        df = self[name]
        return F.broadcast(df) if self.rows(name) <= limit else df

    def with_observations(self, obs: DataFrame) -> Tables:
        return Tables(
            self.provinces,
            self.districts,
            self.settlements,
            self.survey_rounds,
            obs,
            dict(self._rows),
            self.geo,
        )

    def hierarchy(self) -> DataFrame:
        """settlement_id, district_id, province_id for settlements whose district and
        province exist (the inner join chain); the materialised map when present."""
        if self.geo is not None:
            return self.geo
        return hierarchy_keys(self.settlements, self.small("districts"), self.small("provinces"))


def hierarchy_keys(settlements: DataFrame, districts: DataFrame, provinces: DataFrame) -> DataFrame:
    s = settlements.select("settlement_id", "adm2_code")
    d = districts.select("adm2_code", "district_id", "province_id")
    p = provinces.select("province_id")
    return s.join(d, "adm2_code").join(p, "province_id").select("settlement_id", "district_id", "province_id")


def broadcast_if_small(df: DataFrame, limit: int = DIM_BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only when its counted row number is under ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Read the five tables from ``{path}/{table}`` with their declared schemas.

    ``fmt="csv"`` reads the seed format: header row (checked against the declared column
    names), comma separated, FAILFAST on a malformed line (no schema inference).
    """
    dfs = {}
    for name in TABLE_NAMES:
        reader = spark.read.schema(SCHEMAS[name])
        if fmt == "csv":
            df = (
                reader.option("header", True)
                .option("enforceSchema", False)  # header names must match the declared columns
                .option("mode", "FAILFAST")
                .csv(f"{path}/{name}.csv")
            )
        else:
            df = reader.format(fmt).load(f"{path}/{name}")
        dfs[name] = df.select(*SCHEMAS[name].fieldNames())
    return Tables(**dfs)


def write_layout(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: list[str] | None = None,
    num_partitions: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` as Parquet laid out for the access paths the reports use.

    The fact table is range-partitioned on (partition column, sort keys): every task
    writes a contiguous slice, files carry tight min/max statistics on the sort key
    (row-group skipping on settlement_id), and ``partitionBy`` directories give partition
    pruning on round_id. Range partitioning samples the keys, so a round holding most of
    the rows is still split over many tasks rather than landing in one.
    """
    keys = ([partition_by] if partition_by else []) + list(sort_by or [])
    out = df
    if keys:
        n = num_partitions or max(
            int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_FILE)
        )
        out = out.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_tables(
    tables: Tables,
    path: str,
    num_partitions: int | None = None,
    buckets: int | None = None,
    database: str | None = None,
) -> None:
    """Persist all five tables; the fact table partitioned by round, sorted by unit.

    With ``buckets`` and ``database`` the fact and settlement tables are written as
    catalog tables bucketed (and sorted) on settlement_id, at ``{path}/{table}``. Scans of
    bucketed tables report hash partitioning on settlement_id, so per-settlement windows,
    aggregations by settlement and the fact x settlement join run without an exchange.
    Each write task holds exactly one bucket (``repartition(buckets, settlement_id)`` uses
    the bucketing hash), so a table has ``buckets`` files per round directory. The
    settlement -> district -> province key map is written too (``settlement_geo``, bucketed
    the same way): the hierarchy join chain is then evaluated once, at write time.
    """
    if buckets and database:
        _write_bucketed(tables, path, buckets, database)
        return
    for name in TABLE_NAMES:
        if name == "observations":
            write_layout(
                tables.observations, f"{path}/observations", "round_id", ["settlement_id"], num_partitions
            )
        elif name == "settlements":
            write_layout(tables.settlements, f"{path}/settlements", None, ["settlement_id"], num_partitions)
        else:
            tables[name].coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def unit_key_bounded(tables: Tables, buckets: int) -> bool:
    """Whether no settlement holds as many rows as a mean bucket, beyond one row per round
    tenfold; one aggregation by settlement over the fact, three numbers reach the driver."""
    per_unit = tables.observations.groupBy("settlement_id").agg(F.count(F.lit(1)).alias("n"))
    worst, rows = per_unit.agg(F.max("n"), F.sum("n")).first()
    return worst is None or worst <= max(10 * tables.rows("survey_rounds"), rows // max(1, buckets))


def _write_bucketed(tables: Tables, path: str, buckets: int, database: str) -> None:
    """Catalog tables; fact, settlements and the key map bucketed on settlement_id unless one
    settlement fills a bucket by itself (a group of copies): bucketing would put that group
    into one bucket read by one task in every scan, so the tables are then written unbucketed
    (joins and aggregations shuffle, and AQE splits the skewed partitions). A surplus row does
    not change the layout. The choice is recorded as a table property of ``observations``
    (read back by ``load_catalog``), and table statistics are computed for every table. The
    fact is derived once, into ``{path}/_staged``, and checked and bucketed from there."""
    spark = tables.observations.sparkSession
    tables.observations.write.mode("overwrite").parquet(f"{path}/_staged")
    tables = Tables(
        tables.provinces, tables.districts, tables.settlements, tables.survey_rounds, spark.read.parquet(f"{path}/_staged"), geo=tables.geo
    )
    bucketed = unit_key_bounded(tables, buckets)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{path}/_db'")

    def save(df: DataFrame, name: str, by_round: bool = False) -> None:
        if bucketed:
            writer = df.repartition(buckets, "settlement_id").write.bucketBy(buckets, "settlement_id").sortBy("settlement_id")
        else:
            # No repartition: a key-based shuffle would route the hot group to one task.
            writer = df.write
        if by_round:
            writer = writer.partitionBy("round_id")
        writer.mode("overwrite").format("parquet").option("path", f"{path}/{name}").saveAsTable(f"{database}.{name}")

    for name in TABLE_NAMES:
        df = tables[name].select(*SCHEMAS[name].fieldNames())
        if name in ("observations", "settlements"):
            save(df, name, by_round=name == "observations")
        else:
            df.coalesce(1).write.mode("overwrite").format("parquet").option("path", f"{path}/{name}").saveAsTable(
                f"{database}.{name}"
            )
    # The hierarchy chain over the tables just written (dimension broadcasts size-checked;
    # never a key map left from an earlier write).
    written = load_catalog(spark, database)
    written.geo = None
    save(written.hierarchy(), "settlement_geo")
    flag = "true" if bucketed else "false"
    spark.sql(f"ALTER TABLE {database}.observations SET TBLPROPERTIES ('{UNIT_KEY_PROPERTY}' = '{flag}')")
    # Table statistics (row counts, sizes) so Catalyst sizes the joins no report hints.
    for name in [*TABLE_NAMES, "settlement_geo"]:
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS")


def load_catalog(spark: SparkSession, database: str) -> Tables:
    """The five tables from catalog ``database`` (keeps bucketing information), with the
    materialised hierarchy map when the database has one."""
    t = Tables(**{n: spark.table(f"{database}.{n}").select(*SCHEMAS[n].fieldNames()) for n in TABLE_NAMES})
    if spark.catalog.tableExists(f"{database}.settlement_geo"):
        t.geo = spark.table(f"{database}.settlement_geo").select("settlement_id", "district_id", "province_id")
    props = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {database}.observations").collect()}  # a few rows
    if UNIT_KEY_PROPERTY in props:
        t.unit_key_bounded = props[UNIT_KEY_PROPERTY] == "true"
    return t


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``). Only a local session
    without the setting (tests) gets a fresh folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelscope-ckpt-"))
        d = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/panelscope/{tag}-{uuid.uuid4().hex[:12]}"
