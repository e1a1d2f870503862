"""From raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run()
writes each result as Parquet into the cluster's shared folder and reads it again, so a lost
executor costs no more than one stage. All stages but the last return the columns of documents:

1. language: rows whose language is not recognised go;
2. near duplicates: one document of each SimHash group stays;
3. secrets: every secret in a text is replaced by a mark (n_chars follows);
4. mix: rows are taken as often as the source weights ask for;
5. pieces: one row per document and segmentation (the three best), with piece ids.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; a null or letterless text is not recognised as a language, so it ends
at stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelscope.llm import langid, mixing, pieces, secret_scan, simhash
from panelscope.llm.common import scratch_path


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, bits=2)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_repeats=2)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.nbest_encode(docs, n=3)


STAGES = [
    ("language", recognise_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None  # SQL has neither the model nor the lattice; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
