"""The registered queries, one per operator; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.operators import (
    coverage, curves, docvectors, enrichment, frames, models, policies, pool, seeds, variance,
)
from reviewsieve.operators.distances import min_distances
from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.plans.acquire import acquire_round, next_round, start_log
from reviewsieve.plans.study import compare_policies, load_topics
from reviewsieve.registry import fixtures as fx
from reviewsieve.session import cut_lineage
from reviewsieve.sources import articlexml, qrels, sinks, topics, wordvectors

PICKS = [*ROUND, "rank_in_round", "pmid"]


def _r(column: str, places: int = 4) -> Column:
    return F.round(F.col(column).cast("double"), places).alias(column)


def qrels_scan(spark: SparkSession, d: str) -> DataFrame:
    return qrels.judgements(fx.qrels_lines(spark, d)).select(
        "source_set", "cd", "misc", "pmid", "label"
    )


def qrels_rejects(spark: SparkSession, d: str) -> DataFrame:
    return qrels.rejected_lines(fx.qrels_lines(spark, d)).select("source_set", "value", "reason")


def topic_list(spark: SparkSession, d: str) -> DataFrame:
    return qrels.topics(qrels_scan(spark, d))


def _topic_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.versions(spark, d).select(
        F.col("topic").alias("CD"), F.lit("0").alias("Misc"),
        F.col("pmid").cast("string").alias("PMID"), F.col("toxic").cast("string").alias("label"),
        "title", "abstract", "seq",
    )


def topic_scan(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_articles(_topic_rows(spark, d)).select(
        "topic", "pmid", "label", "first_seq", "title", F.md5("abstract").alias("abstract_md5")
    )


def topic_files(spark: SparkSession, d: str) -> DataFrame:
    """Topics written as CSV, a folder each, and read back from there."""
    rows = _topic_rows(spark, d).where(F.col("seq") == F.col("PMID").cast("bigint")).drop("seq")
    folder = fx.landing(spark, "topics")
    sinks.write_by_topic(rows, folder, ["CD"])
    return topics.topic_articles(topics.read_topic_csv(spark, folder)).select(
        "topic", "pmid", "label", F.md5("title").alias("title_md5")
    )


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return pool.topic_counts(fx.judged(spark, d))


def enrich(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrichment.enrich_judgements(qrels_scan(spark, d), fx.records(spark, d))
    return enriched.select(
        "source_set", "cd", "misc", "pmid", "label", "title",
        F.md5("abstract").alias("abstract_md5"),
    )


def enrich_batches(spark: SparkSession, d: str) -> DataFrame:
    """Judgements enriched with first versions, kept, and then given the later ones."""
    records = fx.records(spark, d)
    later = F.col("seq") > F.col("pmid").cast("bigint")
    kept = cut_lineage(
        enrichment.enrich_judgements(qrels_scan(spark, d), records.where(~later), keep_seq=True)
    )
    return enrichment.with_later_records(kept, records.where(later)).select(
        "source_set", "cd", "misc", "pmid", "label", "title",
        F.md5("abstract").alias("abstract_md5"),
    )


def unmatched(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrichment.enrich_judgements(qrels_scan(spark, d), fx.records(spark, d))
    return enrichment.without_record(enriched).select("source_set", "cd", "pmid")


def _xml_columns(spark: SparkSession, d: str, text_mode: str = "first") -> DataFrame:
    return articlexml.record_columns(
        articlexml.split_records(fx.responses(spark, d)), text_mode
    )


def xml_records(spark: SparkSession, d: str) -> DataFrame:
    return _xml_columns(spark, d).select(
        "response", "is_book", "pmid", "title", "book_title", F.md5("abstract").alias("abstract_md5")
    )


def xml_bulk_scan(spark: SparkSession, d: str) -> DataFrame:
    """Responses landed as large files and scanned by byte ranges, one tag at a time."""
    folder = fx.landing(spark, "responses")
    fx.responses(spark, d).select("xml").write.text(folder)
    article = "struct<PMID: string, Article: struct<Journal: struct<Title: string>>>"
    articles = articlexml.scan_records(
        spark, folder, articlexml.ARTICLE_TAG, f"MedlineCitation {article}"
    ).select("MedlineCitation.PMID", F.col("MedlineCitation.Article.Journal.Title").alias("said"))
    books = articlexml.scan_records(
        spark, folder, articlexml.BOOK_TAG, "BookDocument struct<PMID: string, BookTitle: string>"
    ).select("BookDocument.PMID", F.col("BookDocument.BookTitle").alias("said"))
    both = articles.withColumn("is_book", F.lit(False)).unionByName(
        books.withColumn("is_book", F.lit(True))
    )
    return both.select("is_book", F.col("PMID").alias("pmid"), F.col("said").alias("source"))


def xml_full_text(spark: SparkSession, d: str) -> DataFrame:
    return _xml_columns(spark, d, "full").select(
        "pmid", "title", F.md5("abstract").alias("abstract_md5")
    )


def xml_citations(spark: SparkSession, d: str) -> DataFrame:
    cited = articlexml.citation_columns(articlexml.split_records(fx.responses(spark, d)))
    return cited.select(
        "pmid", F.array_join("authors", "; ").alias("authors"), "journal", "pubdate", "doi"
    )


def xml_attributes(spark: SparkSession, d: str) -> DataFrame:
    return articlexml.attribute_columns(
        articlexml.split_records(fx.responses(spark, d)), ["PMID", "BookTitle", "Day"]
    ).select("PMID", "BookTitle", "Day")


def xml_tag_texts(spark: SparkSession, d: str) -> DataFrame:
    found = articlexml.all_tag_texts(articlexml.split_records(fx.responses(spark, d)))
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", "pmid", "text")), 1, 8), 16, 10)
    # Outer, for else Spark makes all texts once more to leave out records without any.
    rows = found.select(F.col("texts")["PMID"].alias("pmid"), F.explode_outer("texts").alias("tag", "text"))
    return rows.where("tag is not null").groupBy("tag").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("text").alias("texts"),
        F.sum(mark.cast("bigint")).alias("mark"),
    )


def xml_rejects(spark: SparkSession, d: str) -> DataFrame:
    return articlexml.rejected_responses(fx.mixed_responses(spark, d)).select("response", "reason")


def xml_requested(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("pmid"))
    return articlexml.requested(_xml_columns(spark, d), labels).select("pmid", "is_book")


def record_text(spark: SparkSession, d: str) -> DataFrame:
    from reviewsieve.functions.text import record_text as shown

    text = shown(*[F.col(c) for c in ("is_book", "pmid", "title", "abstract", "book_title")])
    return _xml_columns(spark, d).select("pmid", F.md5(text).alias("text_md5"))


def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    return articlexml.fetch_plan(fx.article_ids(spark, d))


def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    values = F.array_join(F.transform("vector", lambda v: v.cast("string")), " ")
    lines = fx.vocabulary(spark, d).select(F.concat_ws(" ", "word", values).alias("value"))
    vector = F.col("vector").cast("array<double>")
    total = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v)
    return wordvectors.parse_word_vectors(lines).select(
        "word", F.size("vector").alias("width"), F.round(total, 4).alias("total"),
        F.round(F.get(vector, F.lit(0)), 4).alias("first"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return docvectors.word_counts(fx.articles(spark, d), ["pmid"])


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = docvectors.document_vectors(
        fx.articles(spark, d), fx.vocabulary(spark, d), ["topic", "pmid"]
    )
    return vectors.select("pmid", F.posexplode("features").alias("dim", "value")).select(
        "pmid", "dim", _r("value")
    )


def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return docvectors.shuffled_articles(fx.article_ids(spark, d))


def start_pool(spark: SparkSession, d: str) -> DataFrame:
    return seeds.start_pool(fx.judged(spark, d), size=6, seed=7)


def seed_pools(spark: SparkSession, d: str) -> DataFrame:
    pools = seeds.seed_pools(fx.judged(spark, d), num_pools=5, size=4)
    ids = F.array_join(F.transform("pmids", lambda i: i.cast("string")), ",")
    return pools.select("topic", "pool_id", "attempt", ids.alias("pmids"), "both_classes")


def pool_state(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    log = fx.log_so_far(rows, ("random", "certainty"))
    return pool.pool(rows.select("topic", "pmid"), log).select(*RUN, "pmid")


def run_state(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    return pool.run_state(fx.log_so_far(rows, fx.STUDY_POLICIES), rows).select(
        *RUN, "last_round", "n_labelled", "n_pool", "found", _r("recall"), "done"
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    log = fx.log_so_far(rows, ("random", "certainty"))
    here = pool.pool(rows.select("topic", "pmid"), log).withColumn("round", F.col("run") + 2)
    return pool.candidates(here, 50, seed=3).select(*ROUND, "pmid")


def margins(spark: SparkSession, d: str) -> DataFrame:
    from reviewsieve.functions.hashing import unit_draw

    rows = fx.article_ids(spark, d).select("topic", "pmid", unit_draw(F.lit("p"), "pmid").alias("p"))
    return rows.select("topic", "pmid", F.round(policies.margin("p"), 6).alias("margin"))


def _margin_picks(policy: str, threshold: float = policies.ADAPTIVE_THRESHOLD):
    def query(spark: SparkSession, d: str) -> DataFrame:
        scored = fx.scored_pool(fx.judged(spark, d), (policy,))
        return policies.pick_by_margin(scored, fx.REVEAL, threshold).select(*PICKS)

    return query


def pick_random(spark: SparkSession, d: str) -> DataFrame:
    drawn = fx.scored_pool(fx.judged(spark, d), ("random",))
    return policies.pick_random(drawn, fx.REVEAL).select(*PICKS)


def reveal(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    log = fx.log_so_far(rows, ("random",))
    grown = log.unionByName(pool.reveal(pick_random(spark, d), rows))
    return pool.reveal_positions(grown).select(*ROUND, "rank_in_round", "pos", "pmid", "label")


def _item_pool(
    spark: SparkSession, d: str, policy: str, batch_size: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Pool (whole or drawn) and labelled rows of broken-off reviews of the vectors."""
    rows = fx.items(spark, d)
    log = fx.log_so_far(rows, (policy,))
    here = pool.pool(rows.select("topic", "pmid", "features"), log)
    drawn = pool.candidates(here.withColumn("round", F.col("run") + 2), batch_size)
    labelled = log.select(*RUN, "pmid", "label").join(
        rows.select("topic", "pmid", "features"), ["topic", "pmid"]
    )
    return drawn, labelled


def distances(spark: SparkSession, d: str) -> DataFrame:
    drawn, labelled = _item_pool(spark, d, "diversity")
    return min_distances(drawn, labelled).select(*ROUND, "pmid", _r("min_dist", 6))


def pick_diversity(spark: SparkSession, d: str) -> DataFrame:
    drawn, labelled = _item_pool(spark, d, "diversity")
    return policies.pick_farthest(min_distances(drawn, labelled), fx.REVEAL).select(*PICKS)


def pick_min_variance(spark: SparkSession, d: str) -> DataFrame:
    drawn, labelled = _item_pool(spark, d, "minimum_variance")
    return variance.pick_min_variance(drawn, labelled, 3).select(*PICKS)


def pick_min_variance_batch(spark: SparkSession, d: str) -> DataFrame:
    drawn, labelled = _item_pool(spark, d, "minimum_variance", 50)
    return variance.pick_min_variance(drawn, labelled, 3, batch_size=50).select(*PICKS)


def pick_clustering(spark: SparkSession, d: str) -> DataFrame:
    drawn, _ = _item_pool(spark, d, "clustering")
    return policies.pick_per_cluster(models.cluster(drawn, fx.REVEAL)).select(*PICKS)


def scores(spark: SparkSession, d: str) -> DataFrame:
    drawn, labelled = _item_pool(spark, d, "certainty")
    return models.score(labelled, drawn).select(*ROUND, "pmid", _r("p"))


def _by_class(spark: SparkSession, d: str) -> DataFrame:
    """Ready-made vectors, each class a topic."""
    topic = F.concat(F.lit("class "), F.col("label").cast("string")).alias("topic")
    features = F.col("embedding").cast("array<double>").alias("features")
    return fx.table(spark, d, "embeddings").select(topic, F.col("vec_id").alias("pmid"), features)


def projection(spark: SparkSession, d: str) -> DataFrame:
    points = models.project(_by_class(spark, d), ["topic", "pmid"])
    return points.select("topic", "pmid", _r("x"), _r("y"))


def projection_plane(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_class(spark, d).withColumn("features", F.slice("features", 1, 2))
    return models.project(rows, ["topic", "pmid"]).select("topic", "pmid", _r("x"), _r("y"))


def first_of_all_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.items(spark, d)
    log = start_log(seeds.start_pool(rows, 10), list(policies.POLICIES))
    return acquire_round(
        rows.select("topic", "pmid", "features"), rows.select("topic", "pmid", "label"),
        cut_lineage(log), batch_size=50, reveal_size=10,
    )


def diversity_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of whole pools in a row, with distances carried from each to the next."""
    rows = fx.items(spark, d)
    features, judged = rows.select("topic", "pmid", "features"), rows.select("topic", "pmid", "label")
    log = cut_lineage(start_log(seeds.start_pool(rows, 10), ["diversity"]))
    distances = None
    for _ in range(3):
        step = next_round(features, judged, log, 0, 5, distances=distances)
        log, distances = cut_lineage(log.unionByName(step.picks)), step.distances
    return log.where("round > 0").select(*PICKS, "label")


def frame_points(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.items(spark, d)
    xy = rows.select("topic", "pmid", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    points = frames.frame_points(xy, fx.log_so_far(rows, ("random", "certainty")))
    return points.select(*RUN, "pmid", _r("x"), _r("y"), "label", "from_round")


def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_sizes(fx.reveal_log(fx.judged(spark, d)))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    return curves.recall_curve(fx.reveal_log(rows), rows)


def recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d).select(
        *RUN, "round", "labelled", "found", _r("effort_pct"), _r("recall_pct")
    )


def recall_curve_final(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.judged(spark, d)
    curve = curves.recall_curve(fx.reveal_log(rows), rows, count_seeds=True, include_final=True)
    return curve.select(*RUN, "round", "labelled", "found", _r("effort_pct"), _r("recall_pct"))


def _coverage(prefix: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = fx.items(spark, d)
        curve = coverage.coverage_curve(fx.reveal_log(rows), rows, prefix)
        return curve.select(*RUN, "round", _r("coverage_pct"))

    return query


def curve_auc(spark: SparkSession, d: str) -> DataFrame:
    return curves.curve_auc(_recall(spark, d), "recall_pct").select(*RUN, _r("auc"))


def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.items(spark, d)
    log = fx.reveal_log(rows)
    both = curves.recall_curve(log, rows).join(
        coverage.coverage_curve(log, rows), [*RUN, "round"]
    )
    areas = curves.curve_areas(both, {"auc_recall": "recall_pct", "auc_coverage": "coverage_pct"})
    return curves.policy_summary(areas).select(
        "topic", "policy", "runs", _r("auc_recall"), _r("auc_coverage"), "line"
    )


def curve_grid(spark: SparkSession, d: str) -> DataFrame:
    return curves.curve_grid(_recall(spark, d), "recall_pct").select(
        *RUN, "grid", _r("grid_x"), _r("recall_pct")
    )


def curve_band(spark: SparkSession, d: str) -> DataFrame:
    band = curves.curve_band(curves.curve_grid(_recall(spark, d), "recall_pct"), "recall_pct")
    return band.select("topic", "policy", "grid", "runs", _r("mean"), _r("low"), _r("high"))


def _coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.items(spark, d)
    log = fx.reveal_log(rows)
    both = curves.recall_curve(log, rows).join(coverage.coverage_curve(log, rows), [*RUN, "round"])
    return curves.curve_grid(both, "coverage_pct")


def curve_grid_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage_grid(spark, d).select(*RUN, "grid", _r("grid_x"), _r("coverage_pct"))


def curve_band_coverage(spark: SparkSession, d: str) -> DataFrame:
    band = curves.curve_band(_coverage_grid(spark, d), "coverage_pct")
    return band.select("topic", "policy", "grid", "runs", _r("mean"), _r("low"), _r("high"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.items(spark, d)
    study = compare_policies(fx.reveal_log(rows), rows, rows)

    def band(df: DataFrame, measure: str) -> DataFrame:
        return df.select(
            "topic", "policy", F.lit(measure).alias("measure"), "grid", "runs",
            _r("mean"), _r("low"), _r("high"),
        )

    return band(study.recall_band, "recall").unionByName(band(study.coverage_band, "coverage"))


def loaded_topics(spark: SparkSession, d: str) -> DataFrame:
    loaded = load_topics(spark, _topic_rows(spark, d), fx.vocabulary(spark, d))
    half = (F.size("features") / 2).cast("int")
    return loaded.select(
        "topic", "pmid", "label", "pos",
        F.round(F.get("features", F.lit(0)), 4).alias("title_first"),
        F.round(F.get("features", half), 4).alias("abstract_first"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "qrels_scan": qrels_scan,
    "qrels_rejects": qrels_rejects,
    "topics": topic_list,
    "topic_scan": topic_scan,
    "topic_files": topic_files,
    "topic_counts": topic_counts,
    "enrich": enrich,
    "enrich_batches": enrich_batches,
    "enrich_unmatched": unmatched,
    "xml_records": xml_records,
    "xml_bulk_scan": xml_bulk_scan,
    "xml_full_text": xml_full_text,
    "xml_citations": xml_citations,
    "xml_attributes": xml_attributes,
    "xml_tag_texts": xml_tag_texts,
    "xml_rejects": xml_rejects,
    "xml_requested": xml_requested,
    "record_text": record_text,
    "fetch_plan": fetch_plan,
    "word_vectors": word_vectors,
    "tokens": tokens,
    "doc_vectors": doc_vectors,
    "shuffle": shuffle,
    "start_pool": start_pool,
    "seed_pools": seed_pools,
    "pool_state": pool_state,
    "run_state": run_state,
    "candidates": candidates,
    "margins": margins,
    "pick_uncertainty": _margin_picks("uncertainty"),
    "pick_certainty": _margin_picks("certainty"),
    "pick_alternating": _margin_picks("alternating"),
    "pick_adaptive": _margin_picks("adaptive_certainty_uncertainty", 0.1),
    "pick_random": pick_random,
    "reveal": reveal,
    "min_distances": distances,
    "pick_diversity": pick_diversity,
    "pick_min_variance": pick_min_variance,
    "pick_min_variance_batch": pick_min_variance_batch,
    "pick_clustering": pick_clustering,
    "scores": scores,
    "projection": projection,
    "projection_plane": projection_plane,
    "acquire_round": first_of_all_policies,
    "diversity_rounds": diversity_rounds,
    "frame_points": frame_points,
    "frame_sizes": frame_sizes,
    "recall_curve": recall_curve,
    "recall_curve_final": recall_curve_final,
    "coverage_curve": _coverage("index"),
    "coverage_curve_rounds": _coverage("round"),
    "curve_auc": curve_auc,
    "policy_summary": policy_summary,
    "curve_grid": curve_grid,
    "curve_band": curve_band,
    "curve_grid_coverage": curve_grid_coverage,
    "curve_band_coverage": curve_band_coverage,
    "compare_policies": compared,
    "load_topics": loaded_topics,
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to vectors, a model on a start pool, and the next articles to review."""
    rows = fx.judged(spark, d)
    vectors = docvectors.document_vectors(
        fx.articles(spark, d), fx.vocabulary(spark, d), ["topic", "pmid"]
    )
    features = cut_lineage(vectors.join(rows, ["topic", "pmid"]))
    seeded = start_log(seeds.start_pool(rows, 10), ["uncertainty", "certainty", "random"])
    both = seeded.groupBy("topic").agg(F.count_distinct("label").alias("n")).where("n = 2")
    log = cut_lineage(seeded.join(both, "topic", "left_semi"))
    return acquire_round(
        features.select("topic", "pmid", "features"), rows, log, batch_size=50, reveal_size=25
    )
