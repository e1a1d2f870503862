import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from panelscope.llm.common import scratch_path
from panelscope.llm.warc import archive_pages, export_warc, import_warc, read_records, write_archive

PAGES = "page_id long, url string, html string, sha256 string, header int"
ROWS = [
    (5, "http://a/1", "<p>one</p>", "x", 1),
    (3, "http://a/2", "<p>one</p>", "x", 1),
    (9, "http://a/3", "<p>one</p>", None, 1),
    (4, None, "été\r\n\r\nWARC/1.1\r\n", "x", None),
    (6, "http://a/\r\nX: y", None, "x", 1),
    (7, "http://a/5", "", "x", 1),
    (None, "http://a/6", "<p>null id</p>", "x", 1),
    (8, "http://a/7", "long " * 200_000, "x", 1),
    (8, "http://a/7", "long " * 200_000, "x", 1),
]


def want(rows):
    first = {}
    for i, _, html, *_ in rows:
        html = html or ""
        first[html] = min(first.get(html, (1, 0)), (i is None, i or 0))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = (i is None, i or 0) == first[html or ""]
        out.append((i, len(data), digest, "response" if response else "revisit", None if response else first[html or ""][1]))
    return sorted(out, key=repr)


def test_every_page_comes_back(spark):
    got = archive_pages(spark.createDataFrame(ROWS, PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == want(ROWS)


def test_a_hot_payload_is_stored_once(spark):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(600)]
    path = scratch_path(spark, "warc")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 201 and stored.where("payload = encode('same', 'UTF-8')").count() == 1
    assert read_records(spark, path).where("record_type = 'revisit' and payload = encode('same', 'UTF-8')").count() == 399


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_changed_payload_is_found(spark):
    path, other = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    write_archive(spark.createDataFrame(ROWS, PAGES), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("forged"), "UTF-8"))
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="does not match"):
        read_records(spark, other).collect()


def test_warc_files_round_trip(spark):
    path, out = scratch_path(spark, "warc"), scratch_path(spark, "files")
    write_archive(spark.createDataFrame(ROWS, PAGES), path)
    export_warc(spark, path, out)
    back = {(r["record_id"], r["header"], bytes(r["payload"])) for r in import_warc(spark, out).collect()}
    records = read_records(spark, path).collect()
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    full = {(name(r["record_id"]), r["header"], bytes(r["payload"]) if r["record_type"] == "response" else b"") for r in records}
    assert back == full and import_warc(spark, out).count() == len(ROWS)
