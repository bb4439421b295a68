import hashlib

import pytest
from lodestrata.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "ä" * 120 + "\r\n\r\nWARC/1.1\r\n</p>", "z" * 100
    rows = [(5, "http://a/1", big, "x"), (2, "http://a/2", big, "x"), (9, None, other, "x"), (10, "u\r\nEvil: header", other, None), (11, "http://s", "small", None), (12, "http://s", "small", None), (13, "http://n", None, None), (14, "http://e", "", None), (None, "http://q", big, None), (9, None, other, "x"), (15, "http://y", "y" * 99, None), (16, "http://y", "y" * 99, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def brute(rows):
    first, out = {}, []
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, p in data:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    for i, p in data:
        again = len(p) >= 100 and p in first and i != first[p]
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/a")
    records = warc.read_archive(spark, f"{tmp_path}/a")
    got = [(str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()]
    assert sorted(got, key=str) == brute([(r["page_id"], r["html"]) for r in pages.collect()])
    assert sorted((str(r["id"]), bytes(r["payload"]).decode()) for r in records.collect()) == sorted((str(r["page_id"]), r["html"] or "") for r in pages.collect())
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({r["html"] or "" for r in pages.collect()})


def test_warc_files(spark, pages, tmp_path):
    warc.write_archive(pages, f"{tmp_path}/b")
    records = warc.read_archive(spark, f"{tmp_path}/b")
    warc.export_warc(records, f"{tmp_path}/files", max_records=4)
    parsed = warc.import_warc(spark, f"{tmp_path}/files")
    want = sorted(bytes(r["record"]) for r in records.collect())
    assert sorted(r["header"].encode() + bytes(r["body"]) + b"\r\n\r\n" for r in parsed.collect()) == want


def test_a_changed_payload_is_noticed(spark, pages, tmp_path):
    from pyspark.sql import functions as F

    warc.write_archive(pages, f"{tmp_path}/c")
    spark.read.parquet(f"{tmp_path}/c/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/d/payloads")
    spark.read.parquet(f"{tmp_path}/c/headers").write.parquet(f"{tmp_path}/d/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{tmp_path}/d").select("payload_bytes").collect()


def test_empty(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").count() == 0
