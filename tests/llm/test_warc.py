"""Archives: exact round trips, pushed filters, payloads passed over."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import warc

SCHEMA = "page_id bigint, url string, html string"
PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, "http://a/9\r\nWARC-Type: x", "same"),
    (1, None, None), (2, "http://a/2", ""), (4, "http://a/é", "é \r\n\r\n WARC/1.1\r\n\r\n"),
    (None, "http://a/n", "same"), (6, "http://a/6", "long " * 200_000), (7, "http://a/7", "own"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages):
    first = {}
    for page, _, html in pages:
        if page is not None:
            key = html or ""
            first[key] = min(first.get(key, page), page)
    out = []
    for page, _, html in pages:
        again = page is not None and first[html or ""] < page
        out.append(
            (page, len((html or "").encode()), digest(html), "revisit" if again else "response",
             first[html or ""] if again else None)
        )
    return sorted(out, key=str)


@pytest.fixture(params=["gzip", "none"])
def archive(spark, tmp_path, request):
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3).withColumn("payload", F.lit(1))
    warc.write_pages(pages, path, compression=request.param)
    return path


def test_round_trip(spark, archive):
    rows = warc.page_summary(warc.read_records(spark, archive)).collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES)


def test_payloads_and_headers_come_back(spark, archive):
    rows = {r["record_id"]: r for r in warc.read_records(spark, archive).collect()}
    assert rows["<urn:x-page:4>"]["payload"].decode() == PAGES[5][2]
    assert rows["<urn:x-page:4>"]["target_uri"] == "http://a/é"
    assert rows["<urn:x-page:9>"]["target_uri"] == "http://a/9%0D%0AWARC-Type: x"
    assert rows["<urn:x-page:1>"]["target_uri"] is None
    assert rows["<urn:x-page:9>"]["refers_to"] == "<urn:x-page:3>"
    assert rows["<urn:x-page:5>"]["http_length"] == 4


def test_filters_are_pushed_and_right(spark, archive):
    records = warc.read_records(spark, archive)
    kinds = records.where("record_type = 'revisit'")
    assert {r["record_id"] for r in kinds.collect()} == {f"<urn:x-page:{p}>" for p in (2, 5, 9)}
    both = records.where(F.col("target_uri").isin("http://a/7", "http://a/2") & F.col("refers_to").isNull())
    assert {r["record_id"] for r in both.collect()} == {"<urn:x-page:7>"}
    assert records.where("content_length > 900000").count() == 1


def test_unwanted_blocks_are_not_read(spark, archive, monkeypatch):
    reader = warc.WarcReader({"path": archive})
    tests = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("http_length",), 3)]
    assert list(reader.pushFilters(tests)) == tests[1:]
    sizes = []
    for kind in (warc._Plain, warc._Gzip):
        real = kind.block
        monkeypatch.setattr(kind, "block", lambda self, n, real=real: sizes.append(n) or real(self, n))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in rows} == {"revisit"} and len(rows) == 3 and max(sizes) < 1000
    heads = warc.WarcReader({"path": archive, "payload": "false"})
    rows = [r for p in heads.partitions() for b in heads.read(p) for r in b.to_pylist()]
    assert len(rows) == len(PAGES) and all(r["payload"] is None for r in rows if r["record_type"] == "response")


def test_files_of_other_writers(spark, tmp_path):
    """Members without skip lengths, one after another, with folded header lines."""
    records = [
        warc.record_bytes({"WARC-Type": "warcinfo", "X": "a\r\n b"}, b"software: x\r\n"),
        warc.record_bytes({"WARC-Type": "resource", "Content-Type": "text/plain"}, b"\r\n\r\nbody" * 9000),
        warc.record_bytes({"WARC-Type": "resource"}, b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "_part").write_bytes(b"not an archive")
    for where, times in (("record_type is not null", 3), ("record_type = 'resource'", 2)):
        rows = warc.read_records(spark, f"file://{tmp_path}").where(where).collect()
        assert len(rows) == 2 * times
        assert sorted(len(r["payload"]) for r in rows if r["record_type"] == "resource") == [0, 0, 72000, 72000]


def test_gzip_can_read_our_members(tmp_path):
    data = [os.urandom(1000), b"", b"x" * 100_000]
    assert gzip.decompress(b"".join(map(warc.member, data))) == b"".join(data)


def test_partitions_follow_sizes(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 100)
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "partitionbytes": "250"})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2]


def test_empty_and_repeated_pages(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert warc.read_records(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_pages(spark.createDataFrame([(1, "u", "x")] * 3, SCHEMA), f"file://{tmp_path}/three")
    rows = warc.page_summary(warc.read_records(spark, f"file://{tmp_path}/three")).collect()
    assert [tuple(r)[:1] + tuple(r)[3:] for r in rows] == [(1, "response", None)] * 3


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_cut_off_archives_are_an_error(spark, tmp_path, compression):
    record = warc.record_bytes({"WARC-Type": "resource", "Content-Type": "text/plain"}, os.urandom(1000))
    data = gzip.compress(record) if compression == "gzip" else record
    name = "a.warc.gz" if compression == "gzip" else "a.warc"
    (tmp_path / name).write_bytes(data[: len(data) - 500])
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, f"file://{tmp_path}").select("payload").collect()
