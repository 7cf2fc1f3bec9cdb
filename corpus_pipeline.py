"""From raw documents to packed sequences: five stages, each written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import reviewsieve
from reviewsieve.llm import decontaminate, jaccard, langid, packing, toxicity
from reviewsieve.llm.frames import table, written
from reviewsieve.session import broadcast_if_small

# Workers that do not have the package installed get its functions by value.
cloudpickle.register_pickle_by_value(reviewsieve)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; what they reject goes.

    Texts without a letter (null and empty ones too) are rejected. Each row is judged by its
    text alone, so null doc_ids and repeated rows are kept or not like any other.
    """
    return langid.known_only(docs, langid.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the classifier's threshold, each row judged by its text alone."""
    return toxicity.clean_only(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the least doc_id of each group of near copies, one row of it.

    Rows are judged by doc_id and text: texts that share a doc_id without being near copies
    all stay, repeated rows leave one of them. Rows without a doc_id are in no group and all
    stay; so do, one by one, texts without a word.
    """
    keys = ["doc_id", "_said"]
    later = written(jaccard.later_texts(docs).withColumnRenamed("said", "_said"), "later")
    docs_said = docs.withColumn("_said", jaccard.text_key())
    gone = broadcast_if_small(later.select(*keys))
    kept = docs_said.join(gone, keys, "left_anti").select(*docs.columns)
    again = later.where("first").select(*keys)
    if again.limit(1).count():
        repeated = docs_said.join(broadcast_if_small(again), keys, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(keys).select(*docs.columns))
    return kept


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its text alone."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; every row is packed."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

# The stages fit models, hash and tokenise; tests hold them against brute force instead.
ORACLE_SQL = None


# Bytes of whole texts that a task gathers before it writes them.
ROW_GROUP = 16 * 1024 * 1024


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), ROW_GROUP)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
