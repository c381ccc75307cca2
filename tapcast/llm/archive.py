"""Content-addressed web archive.

Two tables: ``payloads`` stores the bytes of each distinct payload once, under
their SHA-256; ``headers`` keeps every record's exact WARC header block and
the address of its payload. A record is header block, payload and two line
ends, put together again by a join. Of the records with one payload that with
the smallest page id is a response; the others are revisits of it, whose own
block is empty and whose full payload the join still finds.

Addresses are verified: reading recomputes SHA-256 and length of what is
stored and fails on a difference.

Cases: a null payload is an empty one (a payload like any other); a null page
id counts as the largest; records with the same page id and payload have the
same type, and their payload is stored once; a null URL is left out of the
header; line ends in a URL are percent-encoded; an empty table gives two empty
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapcast.llm.common import utf8

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1 (160 bits: 32 digits, no padding)."""
    digest = F.sha1(data)
    digits = []
    for i in range(0, 40, 5):  # five hex digits are four base32 digits
        n = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1
            digits.append(F.lit(_BASE32).substr(digit, F.lit(1)))
    return F.concat(*digits)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write both tables under ``path``. Payload bytes cross the network once,
    keyed by page id, so a payload shared by many pages makes no hot key."""
    last = F.lit(2**63 - 1)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        utf8(F.col(payload_col)).alias("payload"))
    base = base.withColumn("address", F.sha2("payload", 256)).withColumn("k", F.coalesce("page_id", last))
    narrow = base.select("page_id", "k", "url", "address", F.octet_length("payload").cast("long").alias("n"),
                         sha1_base32(F.col("payload")).alias("sha1"))
    narrow.write.parquet(f"{path}/records")
    records = pages.sparkSession.read.schema(narrow.schema).parquet(f"{path}/records")
    owners = records.groupBy("address").agg(F.min("k").alias("owner"))

    kind = F.when(F.col("k") == F.col("owner"), "response").otherwise("revisit")
    revisit = kind == "revisit"
    owner = F.when(F.col("owner") < last, F.col("owner"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(_CRLF))

    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF), line("WARC-Type", kind),
        line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("address"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uuid(owner, F.col("address"))),
                                 line("WARC-Profile", F.lit(_REVISIT)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(_CRLF))
    (records.join(owners, "address")
     .select("page_id", kind.alias("record_type"), F.when(revisit, owner).alias("refers_to"),
             "address", "n", head.cast("binary").alias("header"))
     .write.parquet(f"{path}/headers"))

    once = Window.partitionBy("k", "address").orderBy(F.lit(1))
    (base.select("k", "address", "payload")
     .join(owners.select(F.col("owner").alias("k"), "address"), ["k", "address"])
     .withColumn("copy", F.row_number().over(once)).where("copy = 1")
     .select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads"))


def _verified(payloads: DataFrame) -> DataFrame:
    wrong = F.sha2("payload", 256) != F.col("address")
    return payloads.withColumn("payload", F.when(wrong, F.raise_error(F.lit("payload differs from its address")))
                               .otherwise(F.col("payload")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Original records: page_id, address, record_type, the WARC record's
    bytes, and the full payload (for revisits that of the response). A record
    whose payload isn't stored is an error."""
    heads = spark.read.parquet(f"{path}/headers")
    stored = _verified(spark.read.parquet(f"{path}/payloads"))
    lost = F.raise_error(F.lit("a record's payload is missing")).cast("binary")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((_CRLF * 2).encode())
    return (heads.join(stored, "address", "left").withColumn("payload", F.coalesce("payload", lost))
            .select("page_id", "address", "record_type", F.concat("header", block, end).alias("record"), "payload"))


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as its reconstructed bytes tell: page_id, record_type,
    refers_to, and bytes and SHA-1 of its full payload.

    Each record is put together by the join and taken apart again: the header
    block ends at the first empty line; type, record id, the record referred
    to, digest and length are read from it. A revisit's page is found through
    the id that it refers to. Reading fails where the block's length differs
    from Content-Length, the payload from the digest, a response from its own
    payload, or where a revisit refers to no response."""
    records = reconstruct(spark, path)
    head = F.substring_index(F.col("record").cast("string"), _CRLF * 2, 1)
    size = F.octet_length("record") - F.octet_length("head") - 8  # the empty lines
    block = F.expr("substring(record, octet_length(head) + 5, octet_length(record) - octet_length(head) - 8)")
    kind, sha1 = _field(F.col("head"), "WARC-Type"), sha1_base32(F.col("payload"))
    told = records.withColumn("head", head).select(
        "page_id", "address", "record", "payload", "head", kind.alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"), _field(F.col("head"), "WARC-Refers-To").alias("of"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("digest"), size.alias("size"), sha1.alias("sha1"),
        F.when(kind == "response", block == F.col("payload")).otherwise(F.lit(True)).alias("same"),
        _field(F.col("head"), "Content-Length").alias("length"))
    wrong = (~F.col("record_type").isin("response", "revisit") | (F.col("length") != F.col("size").cast("string"))
             | (F.col("digest") != F.concat(F.lit("sha1:"), "sha1")) | ~F.col("same")
             | ((F.col("record_type") == "revisit") != (F.col("of") != "")))
    facts = told.select(
        "page_id", "address", "record_id", "of", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.concat(F.lit("a header differs from its record: "), "head")).cast("string"))
        .otherwise(F.col("record_type")).alias("record_type"))
    # The records that others refer to; copies of a response have one id.
    named = (facts.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
             .distinct().withColumn("found", F.lit(True)))
    absent = F.raise_error(F.lit("a revisit refers to no response")).cast("string")
    return (facts.join(named, "of", "left").select(
        "page_id", "payload_bytes", F.col("sha1").alias("payload_digest"),
        F.when((F.col("record_type") == "revisit") & F.col("found").isNull(), absent).otherwise(F.col("record_type"))
        .alias("record_type"),
        "refers_to", F.col("address").alias("payload_address")))


def export_warc(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """Plain WARC files: the records in page order within each file. The text
    writer's line separator is the two line ends that close a record."""
    recs = reconstruct(spark, path).sortWithinPartitions("page_id")
    body = F.expr("substring(record, 1, length(record) - 4)")
    (recs.select(body.cast("string").alias("value")).write.option("lineSep", _CRLF * 2)
     .option("compression", compression).text(out))
