"""Registered queries against their SQL twins, on the given tables at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    outcome = compare(spark, con, SF_DIR, name)
    assert outcome.startswith(("same", "rows only")), outcome
    assert ", 0 rows" not in outcome or name == "qrels_rejects"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
