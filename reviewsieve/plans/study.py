"""Entry points over whole studies: load topics with their vectors, compare policies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from reviewsieve.operators import coverage, curves, docvectors
from reviewsieve.operators.pool import RUN
from reviewsieve.session import cut_lineage
from reviewsieve.sources.sinks import kept_features
from reviewsieve.sources.topics import topic_articles


def load_topics(
    spark: SparkSession, rows: DataFrame, vectors: DataFrame, folder: str | None = None, seed: int = 42
) -> DataFrame:
    """``topic, pmid, label, pos, features`` of all articles of all topics.

    ``rows``: the topics' CSV rows as read; of an article's versions the last one counts.
    ``pos`` is its place in the topic's seeded random order. With a ``folder`` the table is
    kept there, with the word vectors, and read again by a later call with the same seed and inputs.
    """

    def build() -> DataFrame:
        articles = cut_lineage(
            topic_articles(rows).select("topic", "pmid", "label", "title", "abstract")
        )
        placed = docvectors.shuffled_articles(articles.select("topic", "pmid", "label"), seed=seed)
        keys = ["topic", "pmid"]
        return placed.join(docvectors.document_vectors(articles, vectors, keys), keys).select(
            "topic", "pmid", "label", "pos", "features"
        )

    if folder is None:
        return build()
    return kept_features(spark, folder, {"seed": seed}, build, vectors, {"rows": rows}).features


class Comparison(NamedTuple):
    """What a study shows: mean areas per policy, and both curves with their bands."""

    summary: DataFrame
    recall_band: DataFrame
    coverage_band: DataFrame


def compare_policies(log: DataFrame, judged: DataFrame, features: DataFrame) -> Comparison:
    """Policies side by side over all runs in ``log``, by recall and by feature coverage.

    ``judged``: ``topic, pmid, label``; ``features``: ``topic, pmid, features``.
    """
    both = cut_lineage(
        curves.recall_curve(log, judged).join(
            coverage.coverage_curve(log, features), [*RUN, "round"]
        )
    )
    areas = curves.curve_areas(both, {"auc_recall": "recall_pct", "auc_coverage": "coverage_pct"})
    bands = [
        curves.curve_band(curves.curve_grid(both, y), y) for y in ("recall_pct", "coverage_pct")
    ]
    return Comparison(curves.policy_summary(areas), *bands)
