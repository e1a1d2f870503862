"""Incremental ingestion of survey rounds with Structured Streaming.

New observation files (any round, any split into files) land in a source folder. One
streaming query reads them with the declared schema and, per micro-batch:

1. writes the batch to the fact table, partitioned by (batch_id, round_id) with dynamic
   partition overwrite, so a batch replayed after a failure replaces its own files, and
2. recomputes the national dashboard rows of the rounds the batch touched, from the
   stored fact table (partition pruning reads only those rounds), and overwrites exactly
   those round partitions of the dashboard table (dynamic partition overwrite).

Dashboard rows are recomputed from the stored table rather than merged from state, so
they stay exact (distinct settlement counts included) however a round is split across
batches. The streaming checkpoint (in the shared checkpoint folder) makes the file
source and the sink restartable (foreachBatch is at-least-once; both writes are idempotent
per batch). Dimension tables (rounds) are static inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from panelscope.plans.views import v4_national_dashboard
from panelscope.sources.schema import OBSERVATIONS
from panelscope.sources.tables import Tables, scratch_path


def start_round_ingest(
    spark: SparkSession,
    source_dir: str,
    fact_dir: str,
    dashboard_dir: str,
    dims: Tables,
    checkpoint: str | None = None,
    available_now: bool = True,
    source_format: str = "parquet",
) -> StreamingQuery:
    """Start the ingest query. ``dims`` supplies the dimension tables (its observations
    are ignored). With ``available_now`` the query processes what is present and stops."""
    stream = spark.readStream.schema(OBSERVATIONS).format(source_format).load(source_dir)

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*OBSERVATIONS.fieldNames()).persist()
        # Idempotent: a replayed batch overwrites its own (batch_id, round_id) partitions.
        (
            rows.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "round_id")
            .parquet(fact_dir)
        )
        # Rounds touched by this batch, as a semi-join: the stored fact is pruned to those
        # round partitions by dynamic partition pruning, nothing goes through the driver.
        touched = rows.select("round_id").distinct()
        fact = read_fact(spark, fact_dir).join(touched, "round_id", "left_semi")
        dash = v4_national_dashboard(dims.with_observations(fact))
        (
            dash.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("round_id")
            .parquet(dashboard_dir)
        )
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(process).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "round-ingest")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_fact(spark: SparkSession, fact_dir: str) -> DataFrame:
    """The ingested fact table (all batches) with the declared observation columns."""
    return spark.read.parquet(fact_dir).select(*OBSERVATIONS.fieldNames())
