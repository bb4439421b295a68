"""WARC archives with content-addressed payloads.

An archive is two tables in one folder. payloads holds the bytes of every distinct payload once, under
their SHA-256; headers holds the exact header block of every record. Joining them by digest gives the
records back, byte for byte, and every payload's digest is verified on the way. Records can also be
written as ordinary WARC files and parsed from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import pick, table
from lodestrata.sources.scratch import new_path

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _header(with_first: DataFrame) -> Column:
    """The header block of each record, with the empty line that ends it."""
    again = F.col("kind") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Writes a record for every row of pages to the archive at path, which must not exist yet.

    The payload is the text in UTF-8 (or the bytes as they are); null is empty. Of records with equal
    payloads of at least min_revisit bytes the one with the smallest id is the response and the others
    revisit it; smaller ones are all responses. A null id is never the smallest, and rows with a null id
    are responses where no row with their payload has an id. Of rows that repeat an id and payload each
    is a response or each a revisit. A null URL leaves its header line out; line ends in URLs become a space.
    """
    rows = pick(pages, id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    hashed = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # Copies are dropped before the shuffle as far as a task sees them.
    once = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("id").alias("first"), F.max("bytes").alias("bytes"))
    once.write.parquet(f"{path}/payloads", compression="zstd")

    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("digest").alias("_digest"), "first")
    placed = hashed.select("id", "url", "digest", "bytes").join(firsts, F.col("digest") == F.col("_digest"))
    again = (F.col("bytes") >= min_revisit) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kinds = placed.withColumn("kind", F.when(again, "revisit").otherwise("response"))
    kinds.select("id", "digest", _header(kinds).alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """id, header, payload, record_type, refers_to, payload_digest, payload_bytes, record: the archive's records.

    payload is the full one, for revisits too; record is the record as it stands in a WARC file: header
    block, the bytes its Content-Length tells, and two line ends. The fields come from the header block.
    Fails if a payload doesn't have the digest under which it is stored.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("_digest"), "payload")
    true = F.sha2("payload", 256) == F.col("_digest")
    checked = stored.select("_digest", "payload", F.when(true, F.octet_length("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("_digest")))).cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(f"{path}/headers")
    field = lambda name, pattern: F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    kind = headers.schema["id"].dataType
    parsed = headers.select(
        "id", "header", field("WARC-Type", "([a-z]+)").alias("record_type"), field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"), F.nullif(field("WARC-Refers-To", f"<{_ID}([^\\r\\n]*)>"), F.lit("")).cast(kind).alias("refers_to")
    )
    joined = parsed.join(checked, F.col("payload_digest") == F.col("_digest"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("id", "header", "payload", "record_type", "refers_to", "payload_digest", "payload_bytes", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str, max_records: int = 10_000) -> None:
    """Writes the column record of read_archive() as gzipped WARC files, at most max_records in each. Payloads must be UTF-8."""
    ends = F.substring(F.col("record").cast("string"), F.lit(1), F.char_length(F.col("record").cast("string")) - 4)
    records.select(ends.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def _parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and body of each record of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        yield head, data[end : end + size]
        at = end + size + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header (string), body (binary): the records of the WARC files, plain or gzipped, in a folder. A file is parsed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                found = list(_parse(data))
                for k in range(0, len(found), 500):
                    part = found[k : k + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([h.decode() for h, _ in part], pa.string()), pa.array([b for _, b in part], pa.binary())], ["header", "body"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, body binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, and the SHA-256 of the rebuilt record; written to an archive and read back."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


SQL = r"""
WITH p AS (SELECT page_id, url, html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p),
k AS (SELECT *, n >= 100 AND page_id <> first AS again, chr(13) || chr(10) AS e FROM f)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
  sha256('WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
    || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]+', ' ', 'g') || e, '') || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Payload-Digest: sha256:' || d || e
    || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || first || '>' || e || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e ELSE '' END
    || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || e || e || CASE WHEN again THEN '' ELSE coalesce(html, '') END || e || e) AS record_sha256 FROM k
"""
