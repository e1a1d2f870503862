"""Stored aggregates behind the summary views, refreshed by round.

``ViewStore`` keeps, per round and province, the partial states that the views' aggregates merge
from: row counts, sums and counts of known values, maxima, counts of conditions; and the bitmaps of
assessed settlements (operators.distinct). Both tables are partitioned by round. A refresh compares
a fingerprint per round (row count and order-free hashes of its rows and of the rows' places) with
the stored one, computes the rounds that differ, and overwrites their partitions only.

The views are then merges of a few rows per province and round: equal to the views over the
observations (averages of integers are exact sums divided once), whatever the number of rows.
Observations without a full hierarchy have the null province: the national figures count them, the
province figures don't.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.expr import round_half_up, safe_div
from panelscope.operators.aggregate import share_of_total, total_over
from panelscope.operators.distinct import distinct_units, unit_bitmaps
from panelscope.operators.geo import province_labels, with_geo, with_rounds
from panelscope.sources.schema import SCHEMAS
from panelscope.sources.tables import Tables, shared_dir

# Means come from a sum and the number of known values of these columns.
AVERAGED = [
    "idp_arrivals",
    "security_situation",
    "humanitarian_aid_delivered",
    "health_clinics_available",
    "schools_available",
    "aid_food_distribution",
    "aid_cash",
    "aid_emergency_shelter",
    "aid_infrastructure",
]


NO_ROUND = -1
# Rows that meet these are counted; an unknown value meets none.
CONDITIONS = {
    "high_threat": "security_situation >= 4",
    "high_conflict": "idp_conflict_severity >= 4",
    "high_disaster": "idp_disaster_severity >= 4",
    "deprived": "health_clinics_available = 0 AND schools_available = 0 AND humanitarian_aid_delivered = 0",
}


def round_states(observations: DataFrame) -> DataFrame:
    """Partial states per (round_id, province_id) of observations with their province."""
    aggregates = [F.max("idp_arrivals").alias("max_idp_arrivals")]
    for c in AVERAGED:
        aggregates += [F.sum(c).cast("long").alias(f"sum_{c}"), F.count(c).alias(f"known_{c}")]
    aggregates += [F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long").alias(f"n_{name}") for name, c in CONDITIONS.items()]
    return observations.groupBy("round_id", "province_id").agg(*aggregates)


TABLES = {
    "fingerprints": "round_id int, n long, x long, y long",
    "states": "province_id long, max_idp_arrivals long, "
    + "".join(f"sum_{c} long, known_{c} long, " for c in AVERAGED)
    + "".join(f"n_{name} long, " for name in CONDITIONS)
    + "round_id int",
    "units": "province_id long, bucket long, bits binary, round_id int",
}


def _mean(column: str, digits: int, scale: float = 1.0) -> Column:
    """ROUND(AVG(column) * scale, digits) from merged states."""
    mean = safe_div(F.sum(f"sum_{column}"), F.sum(f"known_{column}"))
    return round_half_up(mean * F.lit(scale) if scale != 1.0 else mean, digits)


def _percent(flag: str) -> Column:
    return _mean(flag, 1, 100.0)


def _total(column: str) -> Column:
    return F.sum(f"sum_{column}")


class ViewStore:
    """Stored states at ``path``, a folder that the whole cluster sees."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        shared_dir(spark)

    def _read(self, name: str) -> DataFrame:
        """A table of the store; empty when it has none yet."""
        schema = TABLES[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @staticmethod
    def _rows(t: Tables) -> DataFrame:
        """Observations with their province; rows without a round are kept as round NO_ROUND."""
        return with_geo(t.observations, t, how="left").withColumn("round_id", F.coalesce("round_id", F.lit(NO_ROUND)))

    @classmethod
    def fingerprints(cls, t: Tables) -> DataFrame:
        """One row per round: its rows, and two order-free hashes of them and their provinces."""
        rows = cls._rows(t).select(*SCHEMAS["observations"].fieldNames(), "province_id")
        one, other = F.xxhash64(*rows.columns), F.xxhash64(F.lit(1), *reversed(rows.columns))
        return rows.groupBy("round_id").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(F.pmod(other, F.lit(2**31))).alias("y")
        )

    def refresh(self, t: Tables) -> list[int]:
        """Bring the store up to ``t``; returns the rounds that were computed. Rounds that ``t`` no
        longer has are no longer read. A refresh that is cut short leaves the old fingerprints, so
        the next one computes the same rounds again."""
        now = {r["round_id"]: tuple(r) for r in self.fingerprints(t).collect()}  # a row per round
        old = {r["round_id"]: tuple(r) for r in self._read("fingerprints").collect()}
        todo = sorted(r for r, mark in now.items() if old.get(r) != mark)
        if todo:
            rows = self._rows(t).where(F.col("round_id").isin(todo))
            self._overwrite("states", round_states(rows))
            self._overwrite("units", unit_bitmaps(rows, ["round_id", "province_id"], "settlement_id"))
        self.spark.createDataFrame(list(now.values()), TABLES["fingerprints"]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fingerprints")
        return todo

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions of the rounds that ``rows`` has, and no other."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("round_id").parquet(f"{self.path}/{name}")

    def _held(self, name: str) -> DataFrame:
        rounds = self._read("fingerprints").select("round_id")  # a row per round
        return self._read(name).join(F.broadcast(rounds), "round_id", "left_semi")

    def states(self) -> DataFrame:
        return self._held("states")

    def units(self) -> DataFrame:
        return self._held("units")

    def _with_units(self, merged: DataFrame, keys: list[str], out: str) -> DataFrame:
        counts = distinct_units(self.units(), keys, "_units")
        same = F.lit(True)
        for i, k in enumerate(keys):
            counts = counts.withColumnRenamed(k, f"_k{i}")
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = merged.join(counts, same, "left").withColumn(out, F.coalesce("_units", F.lit(0).cast("long")))
        return joined.drop("_units", *[f"_k{i}" for i in range(len(keys))])

    def province_summary(self, t: Tables) -> DataFrame:
        """The province x round view."""
        keys = ["round_id", "province_id"]
        merged = self.states().where("province_id IS NOT NULL").groupBy(*keys).agg(
            _total("idp_arrivals").alias("total_idp_arrivals"),
            _mean("idp_arrivals", 1).alias("avg_idp_per_settlement"),
            F.max("max_idp_arrivals").alias("max_idp_settlement"),
            _mean("security_situation", 3).alias("avg_security_score"),
            F.sum("n_high_threat").alias("high_threat_count"),
            _percent("humanitarian_aid_delivered").alias("pct_aid_delivered"),
            _percent("health_clinics_available").alias("pct_health_access"),
            _percent("schools_available").alias("pct_school_access"),
            _percent("aid_food_distribution").alias("pct_food_aid"),
            _percent("aid_cash").alias("pct_cash_aid"),
            _percent("aid_emergency_shelter").alias("pct_shelter_aid"),
        )
        rows = self._with_units(merged, keys, "settlements_assessed")
        named = with_rounds(rows, t, "round_label", "round_period").join(province_labels(t), "province_id")
        measures = [c for c in merged.columns if c not in keys]
        return named.select("round_id", "round_label", "round_period", "province_id", "province_name", "settlements_assessed", *measures)

    def national_dashboard(self, t: Tables) -> DataFrame:
        """The national view: a row per round."""
        merged = self.states().groupBy("round_id").agg(
            _total("idp_arrivals").alias("total_idp_arrivals"),
            _mean("idp_arrivals", 1).alias("avg_idp_per_settlement"),
            _mean("security_situation", 3).alias("national_avg_security"),
            F.sum("n_high_threat").alias("high_threat_settlements"),
            _percent("humanitarian_aid_delivered").alias("national_aid_coverage_pct"),
            _percent("health_clinics_available").alias("health_access_pct"),
            _percent("schools_available").alias("school_access_pct"),
            _percent("aid_food_distribution").alias("food_aid_pct"),
            _percent("aid_cash").alias("cash_aid_pct"),
            _percent("aid_emergency_shelter").alias("shelter_aid_pct"),
            _percent("aid_infrastructure").alias("infra_aid_pct"),
            F.sum("n_high_conflict").alias("high_conflict_displacement"),
            F.sum("n_high_disaster").alias("high_disaster_displacement"),
            F.sum("n_deprived").alias("triply_deprived_settlements"),
        )
        rows = self._with_units(merged, ["round_id"], "settlements_surveyed")
        measures = [c for c in merged.columns if c != "round_id"]
        return with_rounds(rows, t, "round_label", "round_period").select("round_id", "round_label", "round_period", "settlements_surveyed", *measures)

    def province_burden(self, t: Tables) -> DataFrame:
        """Displacement per province over all rounds, with its share of the national total."""
        merged = self.states().groupBy("province_id").agg(
            _total("idp_arrivals").alias("total_idp_arrivals"), _mean("idp_arrivals", 1).alias("avg_per_settlement")
        )
        rows = self._with_units(merged, ["province_id"], "settlements_assessed")
        rows = rows.withColumn("_national", total_over("total_idp_arrivals")).where("province_id IS NOT NULL")
        return rows.join(province_labels(t), "province_id").select(
            "province_name",
            "settlements_assessed",
            "total_idp_arrivals",
            "avg_per_settlement",
            share_of_total(F.col("total_idp_arrivals"), F.col("_national"), 2).alias("share_of_national_total_pct"),
        )

    def top_provinces(self, t: Tables, round_id: int, k: int) -> DataFrame:
        """The ``k`` provinces with the largest total of a round (merged by name)."""
        of_round = lambda rows: rows.where(F.col("round_id") == round_id).join(province_labels(t), "province_id")
        merged = of_round(self.states()).groupBy("province_name").agg(
            _total("idp_arrivals").alias("total_idps"), _mean("security_situation", 2).alias("avg_security")
        )
        units = distinct_units(of_round(self.units()), ["province_name"], "settlements")
        found = merged.join(units, "province_name").select("province_name", "total_idps", "settlements", "avg_security")
        return found.orderBy(F.desc_nulls_last("total_idps"), "province_name").limit(k)
