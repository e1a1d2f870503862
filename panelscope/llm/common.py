"""Shared helpers of the operators: word splitting, the shared scratch folder, running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"  # the separators of words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 32 * 1024 * 1024  # a side is hinted for broadcast only when its counted size is below


def text_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only a local session without the setting gets a fresh folder of its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if base is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            base = tempfile.mkdtemp(prefix="panelscope-llm-")
        sc.setCheckpointDir(base)
        folder = sc.getCheckpointDir()
    return (base or folder).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/panelscope-llm/{tag}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row, whatever their names and types (maps by their JSON)."""
    quoted = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema}
    return F.xxhash64(
        *[F.to_json(F.struct(quoted[f.name].alias("v"))) if "map<" in f.dataType.simpleString() else quoted[f.name] for f in df.schema]
    )


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def running_total(
    df: DataFrame, value: str, out: str, block: str, order: list[Column | str], group: list[str] | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` in (block, order) order within ``group``, in two
    levels: sums per (group, block), a running sum over those few rows, and a window inside
    each block. ``block`` must follow the order (a coarser key of it) and keep blocks small;
    a group of any size is then spread over its blocks. ``df`` is read twice."""
    keys = list(group or [])
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        F.col(block).alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col(block).eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return (
        df.withColumn("_in", F.sum(value).over(inner))
        .join(starts, on)
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_in", "_start", "_b", *[f"_g{i}" for i in range(len(keys))])
    )
