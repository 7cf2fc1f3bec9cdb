"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.functions.hashing import draw, unit_draw
from reviewsieve.functions.ranking import draw_rank
from reviewsieve.functions.text import after_first_line, explode_article_words, first_line
from reviewsieve.operators.policies import POLICIES
from reviewsieve.operators.pool import RUN, candidates, pool, run_state
from reviewsieve.session import checkpoint_folder, cut_lineage, spread_small

STUDY_POLICIES = ("uncertainty", "certainty", "random", "alternating")
RUNS = 3
SEEDS = 4
REVEAL = 25
# Slots for word hashes per embedding; a slot beyond the embeddings gives no vector.
SLOTS_PER_VECTOR = 2
_NOT_XML = r"[^\t\n\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landing(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that a query writes and reads again."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work on their texts, over all cores even if they are in one file."""
    return spread_small(table(spark, sf_dir, "documents").select(*columns), "doc_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as articles: topic is the language, the first line is the title."""
    text = F.col("text")
    return documents(spark, sf_dir, "doc_id", "lang", "text").select(
        F.col("lang").alias("topic"), F.col("doc_id").alias("pmid"),
        first_line(text).alias("title"), after_first_line(text).alias("abstract"),
    )


def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("topic"), F.col("doc_id").alias("pmid")
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.col("lang").alias("topic"), F.col("doc_id").alias("pmid"), F.col("toxic").alias("label")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made vectors as one topic; class 0 of ten is the included one."""
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id").isNotNull(), "vectors").alias("topic"),
        F.col("vec_id").alias("pmid"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table: a vector for every word whose hash slot is the id of an embedding."""
    words = explode_article_words(articles(spark, sf_dir), ["pmid"]).select("word").distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    slots = max(1, vectors.count() * SLOTS_PER_VECTOR)
    slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % slots
    return cut_lineage(
        words.withColumn("vec_id", slot).join(vectors, "vec_id").select("word", "vector")
    )


def qrels_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of judgement lines; a document without labels gives a line too short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    zero = F.lit("0")
    toxic = rows.select(
        F.concat_ws(" ", "lang", zero, "doc_id", "toxic").alias("value"),
        F.lit("toxic").alias("source_set"),
    )
    quality = rows.select(
        F.concat(F.lit("  "), F.concat_ws("\t", "lang", zero, "doc_id", "quality"), F.lit(" \t"))
        .alias("value"),
        F.lit("quality").alias("source_set"),
    )
    return toxic.unionByName(quality)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with labels, and a later version with another title where quality is 0."""
    labels = table(spark, sf_dir, "labels")
    rows = articles(spark, sf_dir).join(labels.withColumnRenamed("doc_id", "pmid"), "pmid")
    first = rows.withColumn("seq", F.col("pmid"))
    later = rows.where("quality = 0").withColumn("title", F.concat(F.lit("new: "), "title"))
    return first.unionByName(later.withColumn("seq", F.col("pmid") + 1_000_000_000_000))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched records: the versions of all articles that have an abstract."""
    return versions(spark, sf_dir).where("abstract <> ''").select(
        "pmid", "title", "abstract", "seq"
    )


def _xml_text(text: Column) -> Column:
    plain = F.regexp_replace(text, _NOT_XML, "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(char), F.lit(name))
    return plain


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched XML, a few hundred to a response; German ones are book chapters.

    A title goes on behind a child element, a blank abstract has no element at all. Books
    have an editor ahead of their author. Every response begins with a record in a comment.
    """
    text = F.col("text")
    columns = ("doc_id", "lang", "source", "n_chars")
    docs = documents(spark, sf_dir, *columns, "text").select(
        *columns,
        _xml_text(first_line(text)).alias("title"),
        _xml_text(after_first_line(text)).alias("abstract"),
    )

    def tag(name: str, *parts) -> Column:
        return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))

    pmid = tag("PMID", F.col("doc_id").cast("string"))
    title = tag("ArticleTitle", F.col("title"), F.lit("<i>more</i> text"))
    abstract = F.when(F.col("abstract") != "", tag("AbstractText", F.col("abstract"))).otherwise("")
    person = tag("Author", tag("LastName", F.col("source")), tag("ForeName", F.col("lang")))
    group = tag("Author", tag("CollectiveName", F.col("source")))
    editor = tag("Book", tag("AuthorList", tag("Author", tag("LastName", F.lit("editor")))))
    year = tag("Year", (2000 + F.col("n_chars") % 20).cast("string"))
    day = F.when(F.col("n_chars") > 500, tag("Day", F.lit("7"))).otherwise("")
    journal = tag(
        "Journal", tag("Title", F.col("source")), tag("PubDate", year, tag("Month", F.lit("May")), day)
    )
    doi = F.when(
        F.col("n_chars") > 1000,
        F.concat(F.lit('<ArticleId IdType="doi">10.1/'), F.col("doc_id").cast("string"), F.lit("</ArticleId>")),
    ).otherwise("")
    article = tag(
        "PubmedArticle",
        tag(
            "MedlineCitation", pmid,
            tag("Article", journal, title, abstract, tag("AuthorList", person, group)),
        ),
        tag("PubmedData", tag("ArticleIdList", doi)),
    )
    book = tag(
        "PubmedBookArticle",
        tag(
            "BookDocument", pmid, editor, tag("BookTitle", F.col("source")), title, abstract,
            tag("AuthorList", person),
        ),
    )
    record = F.when(F.col("lang") == "de", book).otherwise(article)
    batch = F.floor(F.col("doc_id") / 250).alias("batch")
    gone = "<!-- <PubmedArticle><MedlineCitation><PMID>0</PMID></MedlineCitation></PubmedArticle> -->"
    head = (
        '<?xml version="1.0"?><!DOCTYPE PubmedArticleSet SYSTEM "records.dtd"><PubmedArticleSet>'
        + gone
    )
    return docs.select(batch, "doc_id", record.alias("xml")).groupBy("batch").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "xml"))), lambda r: r["xml"]),
            "\n",
        ).alias("body")
    ).select(
        F.col("batch").alias("response"),
        F.concat(F.lit(head), "body", F.lit("</PubmedArticleSet>")).alias("xml"),
    )


def mixed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per document: an error for Spanish, cut off for French, else good."""
    text = _xml_text(F.col("text"))
    return documents(spark, sf_dir, "doc_id", "lang", "text").select(
        F.col("doc_id").alias("response"),
        F.when(
            F.col("lang") == "es",
            F.concat(F.lit("<eFetchResult><ERROR>no record of "), F.col("doc_id").cast("string"),
                     F.lit("</ERROR></eFetchResult>")),
        ).when(F.col("lang") == "fr", F.concat(F.lit("<PubmedArticleSet><PubmedArticle>"), text))
        .otherwise(F.concat(F.lit("<PubmedArticleSet>"), text, F.lit("</PubmedArticleSet>")))
        .alias("xml"),
    )


def _reviews(rows: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """A whole review per policy and run in drawn order: 4 seeds, then 25 a round."""
    starts = [
        F.struct(
            F.lit(policy).alias("policy"), F.lit(run).alias("run"),
            F.lit(10 * POLICIES.index(policy) + run).alias("seed"),
        )
        for policy in policies
        for run in range(RUNS)
    ]
    drawn = rows.select("topic", "pmid", "label", F.inline(F.array(*starts)))
    drawn = drawn.withColumn("_draw", draw("seed", "pmid"))
    ranked = draw_rank(drawn, RUN, "_draw", ["pmid"], "pos")
    after = F.col("pos") - SEEDS
    return ranked.select(
        *RUN,
        F.when(after <= 0, 0).otherwise(F.ceil(after / REVEAL)).cast("int").alias("round"),
        F.when(after <= 0, F.col("pos")).otherwise((after - 1) % REVEAL + 1).cast("int")
        .alias("rank_in_round"),
        "pmid", "label",
    )


def reveal_log(rows: DataFrame, policies: tuple[str, ...] = STUDY_POLICIES) -> DataFrame:
    """Whole reviews as a written log, as reveal logs are."""
    return cut_lineage(_reviews(rows, policies))


def log_so_far(rows: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """The same reviews broken off, as a written log: run r has done r + 1 rounds."""
    return cut_lineage(_reviews(rows, policies).where(F.col("round") <= F.col("run") + 1))


def scored_pool(rows: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """The whole pools of broken-off reviews, with their next round, recall and a drawn p."""
    log = log_so_far(rows, policies)
    state = run_state(log, rows).select(*RUN, (F.col("last_round") + 1).alias("round"), "recall")
    here = pool(rows.select("topic", "pmid"), log).join(state, RUN)
    return candidates(here, 0).withColumn("p", unit_draw(F.lit("p"), "pmid"))
