"""Bulk XML scans in many byte ranges against a reader of the whole file."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewsieve.sources import xmlscan

TAG = "PubmedArticle"


def record(i, body=""):
    return f"<PubmedArticle><PMID>{i}</PMID><T>é {body}</T></PubmedArticle>"


def plain_records(text):
    """Comments and sections go first, each replaced by as many blanks; then records by pairs of tags."""
    masked = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", lambda m: " " * len(m.group()), text, flags=re.S)
    spans = [m.span() for m in re.finditer(r"<PubmedArticle[\s>].*?</PubmedArticle\s*>", masked, flags=re.S)]
    return [text[a:b] for a, b in spans]


def scan(spark, folder, limit):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(limit))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = xmlscan.read_records(spark, str(folder), TAG).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return rows


PIECES = [
    lambda i: record(i), lambda i: record(i, "x" * 400), lambda i: f"<!-- {record(-i)} -->",
    lambda i: record(i, f"<![CDATA[ {record(-i)} ]]>"), lambda i: f"<!-- open {record(-i) * 3} -->\n",
    lambda i: f"<PubmedArticle a='1'><PMID>{i}</PMID></PubmedArticle >", lambda i: "<PubmedArticle/>",
    lambda i: "<PubmedArticleSet>", lambda i: f"<PubmedBookArticle>{i}</PubmedBookArticle>",
    lambda i: record(i, f"<!-- <![CDATA[ {record(-i)} -->"), lambda i: f"<![CDATA[ <!-- {record(-i)} ]]>",
]


@pytest.mark.parametrize("limit", [700, 100_000_000])
def test_ranges_give_the_same_as_the_whole_file(spark, tmp_path, limit):
    random.seed(4)
    for name in ("a", "b"):
        text = "".join(random.choice(PIECES)(i) for i in range(1, 90)) + "</PubmedArticleSet>\n"
        (tmp_path / f"{name}.xml").write_text(text)
    rows = scan(spark, tmp_path, limit)
    for name in ("a", "b"):
        want = plain_records((tmp_path / f"{name}.xml").read_text())
        own = [r for r in rows if r.response.endswith(f"{name}.xml")]
        assert sorted(r.xml for r in own) == sorted(want) and len(want) > 20
        if limit == 700:
            assert len({r.begin for r in own}) > 10


def test_each_range_is_a_task(spark, tmp_path):
    (tmp_path / "a.xml").write_text("".join(record(i, "y" * 100) for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        read = xmlscan.read_records(spark, str(tmp_path), TAG)
        size = (tmp_path / "a.xml").stat().st_size
        assert read.rdd.getNumPartitions() >= size // 8000
        by_task = read.groupBy(F.spark_partition_id()).count().collect()
        assert len(by_task) >= size // 8000 and sum(r["count"] for r in by_task) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_end_early(spark, tmp_path):
    whole = record(1) + record(2)
    for name, end in (("a", record(3)[:-16]), ("b", "<!-- " + record(3)), ("c", "<![CDATA[ x"), ("d", ""), ("e", "<PubmedArticle>")):
        (tmp_path / f"{name}.xml").write_text(whole + end)
    (tmp_path / "f.xml").write_text("")
    for limit in (60, 100_000_000):
        rows = scan(spark, tmp_path, limit)
        assert sorted((r.response[-5], r.xml) for r in rows) == [(n, record(i)) for n in "abcde" for i in (1, 2)]


def test_typed_scan(spark, tmp_path):
    (tmp_path / "a.xml").write_text(record(7) + "<PubmedArticle><PMID>8</PubmedArticle>")
    rows = xmlscan.scan_records(spark, str(tmp_path), TAG, "PMID long, T string").collect()
    assert [(r.PMID, r.T) for r in rows][0] == (7, "é") and len(rows) == 2
