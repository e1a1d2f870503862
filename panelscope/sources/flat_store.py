"""Normalising flat extracts load by load, with ids that never change.

A store is a folder: a surrogate-key dictionary per dimension, the observations, the rejected
rows, and a table of finished loads, each written as one part per load (``load=n``). A load

1. stages its rows once, with the reason why a row can't be taken (a missing code);
2. finds codes that the dictionaries lack by a left-anti join and numbers them after the largest id
   given out, in the order of the codes (rounds by the number in their label);
3. lists, by settlement, the rounds that earlier loads have and those that this load has repeatedly;
4. gives the rows their ids and these lists by one join with the dictionaries, old and new parts
   together, and rejects rows whose settlement and round an earlier load has (``already loaded``)
   or another row of this load has (``repeated``: the smallest row stays);
5. writes its parts, and its line in the table of loads last.

Parts of a load that didn't get that far are not read and are overwritten by the next try, so a
lost driver costs one load. Old parts are never rewritten: nothing is renumbered, and a load's cost
is its own rows plus the joins with the dictionaries. Accepted and rejected rows are all rows.
A code's attributes are those of its first load; ``changed`` lists later rows that say otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.operators.panel import unit_scan
from panelscope.sources.flat import DIMENSIONS, MEASURES, dimension, distinct_codes, flat_rejects, reject_reason
from panelscope.sources.rejects import split_copies
from panelscope.sources.schema import SCHEMAS
from panelscope.sources.tables import Tables, broadcast_if_small, shared_dir

IDS = {"provinces": "province_id", "districts": "district_id", "settlements": "settlement_id", "survey_rounds": "round_id"}
ROUND_SLOTS = 10_000  # round ids a settlement has room for in observation_id
LOADS = "load int, accepted long, rejected long, top_provinces long, top_districts long, top_settlements long, top_survey_rounds long"


@dataclass
class FlatLoad:
    """What a load did: its number, counts, and (table_name, code) of known codes whose attributes
    differ from the stored ones."""

    load: int
    accepted: int
    rejected: int
    changed: DataFrame


class FlatStore:
    """A store at ``path``, a folder that the whole cluster sees."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        shared_dir(spark)

    def loads(self) -> DataFrame:
        """One row per finished load."""
        return self._read("loads", LOADS)

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _finished(self, name: str, columns: str, last: int | None = None) -> DataFrame:
        """The parts of finished loads, of which ``last`` is the last if the caller knows."""
        last = self._last()["load"] if last is None else last
        return self._read(name, f"{columns}, load int").where(F.col("load") <= last)

    def _last(self) -> dict:
        row = self.loads().orderBy(F.desc("load")).first()
        return row.asDict() if row else dict.fromkeys(["load", *[f"top_{t}" for t in IDS]], 0)

    def keys(self, table: str, last: int | None = None) -> DataFrame:
        """The dictionary of a dimension: id, code, attributes, load."""
        code, attributes = DIMENSIONS[table]
        kinds = {f.name: f.dataType.simpleString() for f in SCHEMAS[table]}
        columns = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in [code, *attributes])
        return self._finished(f"keys/{table}", f"id long, {columns}", last)

    def observations(self, last: int | None = None) -> DataFrame:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["observations"])
        return self._finished("observations", columns, last)

    def rejected(self) -> DataFrame:
        """Rejected rows of all loads as they came, with reason and load (codes and measures)."""
        kinds = {f.name: f.dataType.simpleString() for s in SCHEMAS.values() for f in s}
        columns = [c for code, attributes in DIMENSIONS.values() for c in (code, *attributes)] + MEASURES
        return self._finished("rejected", ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys(columns)) + ", reason string")

    def tables(self) -> Tables:
        """The five tables of all finished loads."""
        last = self._last()["load"]
        keys = {t: self.keys(t, last).withColumn(i, F.col("id").cast(SCHEMAS[t][i].dataType)) for t, i in IDS.items()}
        provinces = keys["provinces"].select("province_id", "adm1_code")
        keys["districts"] = keys["districts"].join(broadcast_if_small(provinces), "adm1_code")
        return Tables(**{n: (keys[n] if n in keys else self.observations(last)).select(*SCHEMAS[n].fieldNames()) for n in SCHEMAS})

    def _number_new(self, table: str, found: DataFrame, known: DataFrame, top: int) -> DataFrame:
        code, _ = DIMENSIONS[table]
        new = found.join(known.select(code), code, "left_anti")
        if table == "settlements":  # they grow with the panel: a running count over ranges of them
            new = new.withColumns({"_one": F.lit(1), "_all": F.lit(0)})
            new = unit_scan(new, "_all", [code], "_one", cum="id").drop("_one", "_all")
            return new.withColumn("id", (F.col("id") + top).cast("long"))
        order = [code]
        if table == "survey_rounds":
            number = F.nullif(F.regexp_extract(code, r"(\d+)", 1), F.lit(""))
            order = [number.cast("long"), code]
        return new.withColumn("id", (F.row_number().over(Window.orderBy(*order)) + top).cast("long"))

    def _units(self, rows: DataFrame, rounds: DataFrame, settlements: DataFrame, last: int) -> DataFrame:
        """Settlements by code with the lists of round ids that earlier loads have (``_loaded``)
        and that several of ``rows`` have (``_repeated``), NULL for none; kept, as it is read
        several times. Lists hold at most ROUND_SLOTS ids."""
        units = settlements.select(F.col("id").alias("settlement_id"), "settlement_code")
        before = self.observations(last).select("settlement_id", F.col("round_id").cast("long").alias("round_id"))
        loaded = before.groupBy("settlement_id").agg(F.collect_set("round_id").alias("_loaded"))
        counts = rows.groupBy("settlement_code", "round_label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        repeated = counts.join(rounds, "round_label").groupBy("settlement_code").agg(F.collect_set("round_id").alias("_repeated"))
        return units.join(loaded, "settlement_id", "left").join(repeated, "settlement_code", "left").checkpoint()

    def append(self, flat: DataFrame) -> FlatLoad:
        """Take a flat extract (geography, settlement and round columns, measures) as a new load."""
        spark, last = self.spark, self._last()
        n = last["load"] + 1
        part = lambda name: f"{self.path}/{name}/load={n}"
        needed = dict.fromkeys([c for code, attributes in DIMENSIONS.values() for c in (code, *attributes)] + MEASURES)
        flat.select(*needed).write.mode("overwrite").parquet(part("staged"))
        staged = spark.read.parquet(part("staged"))
        rows = staged.where(reject_reason().isNull())

        tops, changed, keys, distinct = {}, None, {}, distinct_codes(rows)
        for table, (code, attributes) in DIMENSIONS.items():
            found = dimension(distinct, table).drop("variants")
            known = self.keys(table, last["load"])
            self._number_new(table, found, known, last[f"top_{table}"]).write.mode("overwrite").parquet(part(f"keys/{table}"))
            fresh = spark.read.parquet(part(f"keys/{table}"))
            tops[table] = fresh.agg(F.max("id")).first()[0] or last[f"top_{table}"]
            keys[table] = known.select("id", code).unionByName(fresh.select("id", code))
            old = known.select(code, F.struct(*attributes).alias("_stored"))
            differs = distinct[table].select(code, F.struct(*attributes).alias("_now")).distinct().join(old, code).where("_now <> _stored")
            differs = differs.select(F.lit(table).alias("table_name"), F.col(code).cast("string").alias("code")).distinct()
            changed = differs if changed is None else changed.unionByName(differs)
        if tops["survey_rounds"] > ROUND_SLOTS:
            raise ValueError(f"more than {ROUND_SLOTS} rounds: observation ids would meet")

        rounds = broadcast_if_small(keys["survey_rounds"].select(F.col("id").alias("round_id"), "round_label"))
        units = self._units(rows, rounds, keys["settlements"], last["load"])
        n_loaded, n_repeated = units.agg(F.count("_loaded"), F.count("_repeated")).first()
        among = lambda rounds: F.coalesce(F.array_contains(rounds, F.col("round_id")), F.lit(False))
        placed = lambda units: rows.join(rounds, "round_label").join(units, "settlement_code")
        plain = lambda frame: frame.drop("_loaded", "_repeated")
        first = plain(placed(units).where(~among("_loaded") & ~among("_repeated")))
        away = [flat_rejects(staged)]
        if n_loaded:
            loaded = plain(placed(units.where("_loaded IS NOT NULL")).where(among("_loaded")))
            away.append(loaded.withColumn("reason", F.lit("already loaded")))
        if n_repeated:
            repeats = placed(units.where("_repeated IS NOT NULL")).where(among("_repeated") & ~among("_loaded"))
            least, surplus = split_copies(plain(repeats), ["settlement_id", "round_id"])
            first = first.unionByName(least)
            away.append(surplus.withColumn("reason", F.lit("repeated")))
        observation_id = (F.col("settlement_id") - 1) * ROUND_SLOTS + F.col("round_id")
        taken = first.withColumn("observation_id", observation_id).withColumn("round_id", F.col("round_id").cast("int"))
        taken.select(*SCHEMAS["observations"].fieldNames()).write.mode("overwrite").parquet(part("observations"))
        rejected = away[0].select(*needed, "reason")
        for frame in away[1:]:
            rejected = rejected.unionByName(frame.select(*needed, "reason"))
        rejected.write.mode("overwrite").parquet(part("rejected"))

        changed.write.mode("overwrite").parquet(part("changed"))
        counts = [spark.read.parquet(part(name)).count() for name in ("observations", "rejected")]
        line = (n, *counts, *[tops[t] for t in IDS])
        spark.createDataFrame([line], LOADS).coalesce(1).write.mode("append").parquet(f"{self.path}/loads")
        return FlatLoad(n, *counts, spark.read.parquet(part("changed")))
