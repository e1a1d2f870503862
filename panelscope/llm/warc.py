"""WARC: a content-addressed archive. Payload bytes are stored once, under their verified
SHA-256; the exact record headers are kept in a table of their own; the original records come
back through a join of the two.

An archive is a folder with two Parquet tables:

* ``payloads``: sha256, payload, payload_bytes, payload_digest (bare base32 SHA-1), first_id;
* ``records``: record_id, sha256, record_type, header (the record's exact bytes up to its
  payload: the WARC header block and the block's HTTP header).

Of the rows with equal payloads the one with the smallest id is a ``response`` record, the
others are ``revisit`` records without payload that refer to it. ``read_records`` joins both
tables, recomputes every digest and raises an error on bytes that do not match their key.
``export_warc`` and ``import_warc`` turn an archive into WARC/1.1 files and back.

The payload table is written from the first row of each digest, chosen by a window with a
limit of one, which Spark applies to each task's rows before the shuffle; a payload that a
third of the rows share moves once per task. The joins on the digest have one row per digest
on one side and split their large partitions at run time.

Edge cases: a null payload is empty; a null url has no WARC-Target-URI; a null id counts as the
largest and is written as ``null``; rows that repeat the smallest id of a payload are all
response records; a payload of any length is one record, as one cell; an empty table makes an
empty archive; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm.common import scratch_path

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits, four letters each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def _header(http: Column, is_first: Column, date: str) -> Column:
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    length = F.octet_length(http) + F.when(is_first, F.col("payload_bytes")).otherwise(0)
    revisit = F.concat(line("WARC-Refers-To", name("first_id")), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(is_first, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", name("record_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_first, F.lit("")).otherwise(revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write the archive of ``pages`` to the folder ``path``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "sha256", F.sha2("payload", 256)
    )
    first = Window.partitionBy("sha256").orderBy(F.col("record_id").asc_nulls_last())
    (
        rows.select("sha256", "payload", "record_id")
        .withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .select(
            "sha256",
            "payload",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
            F.col("record_id").alias("first_id"),
        )
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    firsts = spark.read.parquet(f"{path}/payloads").drop("payload")
    is_first = F.col("record_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    (
        rows.select("record_id", "url", "sha256")
        .join(firsts, "sha256")
        .select(
            "record_id",
            "sha256",
            F.when(is_first, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
            _header(http, is_first, date).alias("header"),
        )
        .write.option("compression", "zstd")
        .parquet(f"{path}/records")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: record_id, record_type, refers_to, target_uri, payload_digest,
    payload (the full one, of revisits too), header. What describes a record is parsed from its
    header; payload, key and header must agree."""
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "sha256", "payload", F.sha2("payload", 256).alias("found"), base32_sha1(F.col("payload")).alias("sha1")
    )
    records = spark.read.parquet(f"{path}/records").select("sha256", "header")
    field = lambda name, value="([^\r\n]*)": F.nullif(
        F.regexp_extract("header", f"\r\n{name}: {value}\r\n", 1), F.lit("")
    )
    digest = field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)")
    right = (F.col("found") == F.col("sha256")) & (digest == F.col("sha1"))
    payload = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")))
    page = lambda name: F.nullif(field(name, "<urn:page:([^>]*)>"), F.lit("null")).cast("long")
    return records.join(payloads, "sha256").select(
        page("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        digest.alias("payload_digest"),
        payload.alias("payload"),
        "header",
    )


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write ``pages`` to an archive and read it back: one row per page."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, id_col, **columns)
    return read_records(spark, path).select(
        F.col("record_id").alias(id_col),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Write an archive's records as WARC/1.1 files: header, the payload of response records,
    and the two line ends that close a record."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", F.col("payload").cast("string").alias("payload"))
    records = spark.read.parquet(f"{path}/records").join(payloads, "sha256")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    records.select(F.concat("header", body).alias("value")).write.option("lineSep", CRLF + CRLF).text(out)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for data in files["content"]:
            found, at = [], 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
                start = end + 4
                stop = start + int(fields[b"Content-Length"])
                split = data.index(b"\r\n\r\n", start, stop) + 4
                text = {k.decode().lower(): v.decode() for k, v in fields.items()}
                found.append(
                    (
                        text["warc-record-id"],
                        text["warc-type"],
                        text.get("warc-refers-to"),
                        text.get("warc-target-uri"),
                        data[at:split].decode(),
                        bytes(data[split:stop]),
                    )
                )
                at = stop + 4
                if len(found) >= 256:
                    yield pd.DataFrame(found, columns=WARC_COLUMNS)
                    found = []
            yield pd.DataFrame(found, columns=WARC_COLUMNS)


WARC_COLUMNS = ["record_id", "record_type", "refers_to", "target_uri", "header", "payload"]


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of (uncompressed) WARC files, parsed by their Content-Length."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "record_id string, record_type string, refers_to string, target_uri string, header string, payload binary"
    return files.mapInPandas(_parse, schema)
