"""Manifests against trees built node by node, and proofs against changed rows."""

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewsieve.llm import merkle

SCHEMA = "doc_id long, lang string, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_log(leaves):
    """Postorder of the tree over ``leaves`` by recursion, and its levels by pairs."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([h(*level[i : i + 2]) for i in range(0, len(level), 2)])
    out = []

    def visit(k, p):
        for child in (2 * p, 2 * p + 1) if k else ():
            if child < len(levels[k - 1]):
                visit(k - 1, child)
        out.append(levels[k][p])

    visit(len(levels) - 1, 0)
    return out, levels


def plain_proofs(levels):
    proofs = []
    for i in range(len(levels[0])):
        found = []
        for k, level in enumerate(levels[:-1]):
            other = (i >> k) ^ 1
            if other < len(level):
                found.append(level[other])
        proofs.append(found)
    return proofs


def plain_manifest(rows):
    """Per row ``leaf, subroot, root, siblings`` in the order of groups and leaves."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], h(*map(value, row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        leaves = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((leaves, plain_log([leaf for _, leaf in leaves])[1]))
    _, top = plain_log([levels[-1][0] for _, levels in trees])
    out = []
    for (leaves, levels), above in zip(trees, plain_proofs(top), strict=True):
        for (doc_id, leaf), own in zip(leaves, plain_proofs(levels), strict=True):
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], own + above))
    return out


def manifest(df, bits):
    leaf = merkle.record_digest([F.col("doc_id"), F.col("lang"), F.col("text")])
    return merkle.build(df, leaf, "lang", "doc_id", {"doc_id": F.col("doc_id")}, bits)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200))
def test_log_is_a_postorder(n):
    leaves = [h(str(i)) for i in range(n)]
    want, levels = plain_log(leaves)
    height = merkle.height_of(n)
    log = merkle.append_log(leaves, height)
    assert log.hex() == "".join(want) and len(want) == merkle.subtree_size(n, height)
    for k, level in enumerate(levels):
        ends = np.minimum((np.arange(len(level)) + 1) << k, n) - 1
        assert [want[p] for p in merkle.position(k, ends)] == level


ODD = [
    (None, None, None), (None, None, None), (3, None, "a"), (5, "", "é€"), (5, "", "é€"),
    (5, "", "other"), (None, "", ""), (1, "z", "x" * 200_000), (2, "ü", "1:2"), (-4, "z", None),
]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_nulls_ties_repeats_and_clashing_names(spark, bits):
    rows = ODD + [(i, "many", str(i)) for i in range(37)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("_n", F.lit("x"))
    made = manifest(df.repartition(5), bits)
    got = [
        (r["doc_id"], r["leaf"], r["subroot"], r["root"], merkle.siblings(r["proof"]))
        for r in merkle.folded(merkle.proofs(made), "leaf").collect()
        if r["folded_root"] == r["root"] and r["proof_sha256"] == h(*merkle.siblings(r["proof"]))
    ]
    key = lambda r: (r[1], r[4])
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)


@pytest.mark.parametrize("bits", [1, 3])
def test_log_of_all_builders(spark, bits):
    rows = [(i, "a" if i % 3 else None, str(i)) for i in range(50)]
    made = manifest(spark.createDataFrame(rows, SCHEMA), bits)
    logs = {}
    for r in merkle.log_of(made).collect():
        logs.setdefault(r["tree"], {})[r["position"]] = r["digest"]
    for tree, lang in (("", None), ("+a", "a")):
        value = lambda v: "-" if v is None else f"{len(v)}:{v}"
        leaves = [h(value(str(i)), value(lang), value(str(i))) for i, g, _ in rows if g == lang]
        want, _ = plain_log(leaves)
        assert [logs[tree][p] for p in range(len(logs[tree]))] == want


def test_a_changed_row_does_not_verify(spark):
    rows = [(i, "ab"[i % 2], str(i)) for i in range(21)]
    proved = merkle.proofs(manifest(spark.createDataFrame(rows, SCHEMA), 2))
    forged = F.when(F.col("doc_id") == 6, F.sha2(F.lit("forged").cast("binary"), 256))
    out = merkle.folded(proved.withColumn("given", F.coalesce(forged, "leaf")), "given").collect()
    assert {r["doc_id"] for r in out if r["folded_root"] != r["root"]} == {6}


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    row = merkle.folded(merkle.proofs(manifest(df, 10)), "leaf").first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof"] == b""
    assert row["proof_sha256"] == h()
    assert merkle.proofs(manifest(df.limit(0), 10)).count() == 0


def test_any_partitioning_gives_the_same(spark):
    df = spark.range(3000).selectExpr("id % 900 AS doc_id", "IF(id < 2000, 'hot', 'x') AS lang", "'t' AS text")
    one, two = (
        sorted(map(tuple, merkle.proofs(manifest(d, 4)).select("leaf_index", "subroot", "root").collect()))
        for d in (df.coalesce(1), df.repartition(23))
    )
    assert one == two
