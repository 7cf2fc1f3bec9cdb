"""Sinks: tables per topic, the combined table, and the feature table kept between runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.session import broadcast_if_small, cut_lineage

# Bytes of text that a topic's file holds.
FILE_MAX_BYTES = 64 * 1024 * 1024


def write_by_topic(
    enriched: DataFrame, path: str, by: list[str], fmt: str = "csv", max_rows: int = 1_000_000,
    max_bytes: int = FILE_MAX_BYTES,
) -> None:
    """One folder per ``by`` value, a topic's rows in as many files as ``max_rows`` and ``max_bytes`` need.

    Rows are dealt out by topic and a salt of that many values, so a topic does not get a
    file from every task, and a large one is not written by one task, nor read by one where
    files cannot be split. ``max_bytes`` of text is what a file gets on average.
    """
    size = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in enriched.columns]
    needed = F.greatest(
        F.count(F.lit(1)) / F.lit(max_rows), F.sum(sum(size[1:], size[0]).cast("bigint")) / F.lit(max_bytes)
    )
    files = enriched.groupBy(*by).agg(F.ceil(needed).cast("int").alias("_files"))
    files = cut_lineage(files.select(F.struct(*by).alias("_by"), "_files"))
    cells = files.agg(F.sum("_files")).first()[0] or 1
    sized = enriched.withColumn("_by", F.struct(*by)).join(broadcast_if_small(files), "_by")
    salt = F.pmod(F.xxhash64(*enriched.columns), F.col("_files"))
    # Twice as many parts as files, so that few parts hold two of them.
    dealt = sized.withColumn("_salt", salt).repartition(2 * cells, *by, "_salt")
    enriched = dealt.select(*enriched.columns)
    writer = enriched.write.partitionBy(*by).option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).mode("error").save(path)


def write_combined(enriched: DataFrame, path: str, fmt: str = "parquet") -> None:
    enriched.write.format(fmt).mode("error").save(path)


class Kept(NamedTuple):
    """A kept feature table and the word vectors it was made with."""

    features: DataFrame
    vectorizer: DataFrame


def fingerprint(df: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: their number and a hash of all of them.

    Three sums of a row's hash, so that equal rows do not cancel out.
    """
    row = F.xxhash64(*df.columns)
    parts = [F.shiftrightunsigned(row, at).bitwiseAND(F.lit((1 << 21) - 1)) for at in (0, 21, 42)]
    sums = [F.coalesce(F.sum(p.cast("decimal(20,0)")), F.lit(0)).cast("string") for p in parts]
    return df.agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums).alias("f")).first().f


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{folder}/manifest").first().value)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _commit(spark: SparkSession, folder: str, attempt: str, manifest: dict) -> bool:
    """Put the manifest in its place by one rename; False if another writer has been there."""
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    line.coalesce(1).write.text(f"{attempt}/manifest")
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(f"{attempt}/manifest"), hadoop.Path(f"{folder}/manifest")
    conf = spark._jsc.hadoopConfiguration()
    qualified = target.getFileSystem(conf).makeQualified(target)
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(qualified.toUri(), conf).rename(source, qualified, none)
    except Py4JJavaError as problem:
        if problem.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _read(spark: SparkSession, folder: str, manifest: dict, wanted: dict) -> Kept:
    found = {k: manifest[k] for k in ("params", "inputs")}
    if found != wanted:
        raise ValueError(f"features in {folder} were built with {found}, not with {wanted}")
    data = f"{folder}/{manifest['data']}"
    return Kept(spark.read.parquet(f"{data}/features"), spark.read.parquet(f"{data}/vectorizer"))


def kept_features(
    spark: SparkSession,
    folder: str,
    params: dict,
    build: Callable[[], DataFrame],
    vectorizer: DataFrame,
    inputs: dict[str, DataFrame] | None = None,
) -> Kept:
    """The feature table under ``folder`` with its vectoriser: read if kept, else built and kept.

    Every writer writes both tables to a folder of its own and then renames a manifest into place,
    which names that folder, the parameters and the fingerprints of the inputs. Before the rename
    nothing is kept, after it all is: a writer that fails leaves only files that nobody reads, and of
    two writers the first one's tables count for both. Parameters or inputs other than the kept ones
    are an error. The store's rename must fail where its target exists, as Hadoop's does.
    """
    prints = {name: fingerprint(df) for name, df in ({"vectorizer": vectorizer} | (inputs or {})).items()}
    wanted = {"params": json.loads(json.dumps(params)), "inputs": prints}
    manifest = _manifest(spark, folder)
    if manifest is None:
        name = f"data-{uuid.uuid4().hex}"
        attempt = f"{folder}/{name}"
        build().write.parquet(f"{attempt}/features")
        vectorizer.write.parquet(f"{attempt}/vectorizer")
        if _commit(spark, folder, attempt, wanted | {"data": name}):
            manifest = wanted | {"data": name}
        else:
            manifest = _manifest(spark, folder)
    return _read(spark, folder, manifest, wanted)
