"""The registered queries: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelscope.llm import langid, oracle
from panelscope.llm.ann import nearest
from panelscope.llm.conversation_repair import repair_reports
from panelscope.llm.decontamination import decontaminate
from panelscope.llm.divergence import quality
from panelscope.llm.filter_audit import audit_filters
from panelscope.llm.license_scan import scan_licenses
from panelscope.llm.mixing import mix
from panelscope.llm.pieces import nbest_encode
from panelscope.llm.secret_scan import scan_secrets
from panelscope.llm.simhash import simhash_components
from panelscope.llm.url_filter import url_filter
from panelscope.llm.warc import archive_pages

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_encode(table(spark, sf_dir, "documents"), n=3)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("at")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_license_scan,
        op3_mixing,
        op4_simhash,
        op5_url_filter,
        op6_nearest,
        op7_warc,
        op8_language_id,
        op9_quality,
        op10_secret_scan,
        op11_filter_audit,
        op12_decontamination,
        op13_conversation_repair,
    )
} | {"pipeline": corpus_pipeline.run}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_LOWER}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
    "op7_warc": """
WITH hashed AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), digests AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM hashed
), written AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
      (CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST([32768, 1024, 32, 1][k % 4 + 1] AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM digests
), firsts AS (
  SELECT payload_digest AS d, min(page_id) AS first_id FROM written GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM written JOIN firsts ON d = payload_digest
""",
    "op11_filter_audit": oracle.FILTER_AUDIT,
    "op12_decontamination": oracle.DECONTAMINATION,
    "op13_conversation_repair": oracle.CONVERSATION_REPAIR,
}
