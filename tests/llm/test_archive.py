import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tapcast.llm import archive, queries
from tapcast.llm.common import shared_path

from .cases import SF

ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nEvil: 1", "<p>x</p>"), (3, None, None), (4, "http://c/", ""),
        (5, "http://d/", "ü\r\n\r\nWARC/1.1\r\n"), (5, "http://d/", "ü\r\n\r\nWARC/1.1\r\n"), (None, "http://e/", "<p>x</p>"),
        (None, None, "alone"), (0, "http://f/", "y" * 100000)]


def written(spark, rows):
    path = shared_path(spark, "a")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as address", "'x' as k", "'x' as n")
    archive.write_archive(df.repartition(2), path)
    return path


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_against_brute_force(spark):
    pages = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet' order by 1").fetchall()
    first = {}
    for i, h in pages:
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in queries.op7_content_archive(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, h in pages:
        r, data = got[i], (h or "").encode()
        lead = first[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32(data))
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))


def test_awkward_rows(spark):
    path = written(spark, ROWS)
    got = archive.read_records(spark, path).collect()
    kinds = sorted((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == sorted([
        (0, "response", 0, 100000), (1, "response", 0, 8), (2, "revisit", 1, 8), (3, "response", 0, 0),
        (4, "revisit", 3, 0), (5, "response", 0, 16), (5, "response", 0, 16), (99, "revisit", 1, 8), (99, "response", 0, 5)])
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("address").distinct().count() == 5


def parse(data):
    """All records of a WARC file, by their Content-Length."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at:end].decode().strip().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end:end + n]))
        assert data[end + n:end + n + 4] == b"\r\n\r\n"
        at = end + n + 4
    return out


def test_records_round_trip_through_warc_files(spark, scratch):
    path = written(spark, ROWS)
    recs = archive.reconstruct(spark, path).collect()
    full = sorted(bytes(r.payload) for r in recs)
    assert full == sorted((h or "").encode() for _, _, h in ROWS)
    archive.export_warc(spark, path, f"{scratch}/warc")
    files = spark.read.format("binaryFile").load(f"{scratch}/warc").select("content").collect()
    found = [x for f in files for x in parse(bytes(f.content))]
    assert len(found) == len(ROWS)
    for head, block in found:
        if head["WARC-Type"] == "response":
            assert head["WARC-Payload-Digest"] == "sha1:" + b32(block)
        else:
            assert block == b"" and "WARC-Refers-To" in head
        assert "Evil" not in head


def test_damage_is_found(spark):
    path = written(spark, ROWS)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('other' as binary) as payload")
    other = shared_path(spark, "a")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="differs from its address"):
        archive.read_records(spark, other).collect()


def test_empty_table(spark):
    path = written(spark, [])
    assert archive.read_records(spark, path).count() == 0


@pytest.mark.parametrize("old, new, what", [
    ("Content-Length: 8", "Content-Length: 9", "differs from its record"),
    ("WARC-Type: response", "WARC-Type: resource", "differs from its record"),
    ("Payload-Digest: sha1:", "Payload-Digest: sha1:A", "differs from its record"),
    ("WARC-Type: revisit", "WARC-Type: response", "differs from its record"),
    ("WARC-Refers-To: <urn:uuid:", "WARC-Refers-To: <urn:uuid:0", "refers to no response")])
def test_damaged_headers_are_found(spark, old, new, what):
    path, other = written(spark, ROWS), shared_path(spark, "a")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{other}/payloads")
    heads = spark.read.parquet(f"{path}/headers")
    text = F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new))
    heads.withColumn("header", text.cast("binary")).write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match=what):
        archive.read_records(spark, other).collect()
