"""Text expressions: splitting, tokens and display lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of word characters that are not decimal digits; word length limits.
WORD_RUN = r"([\p{L}\p{Nl}\p{No}_]+)"
WORD_MIN, WORD_MAX = 2, 15


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    cut = F.instr(text, "\n")
    return F.when(cut > 0, F.substr(text, cut + F.lit(1))).otherwise(F.lit(""))


def is_word(word: str) -> Column:
    return F.length(word).between(WORD_MIN, WORD_MAX) & ~F.startswith(F.col(word), F.lit("_"))


def word_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(1))


def kept_words(text: Column) -> Column:
    """All words of a text in order, by the rule of ``explode_words``; an empty list for null."""
    kept = F.filter(
        word_runs(text),
        lambda w: F.length(w).between(WORD_MIN, WORD_MAX) & ~F.startswith(w, F.lit("_")),
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def explode_words(df: DataFrame, keep: list[str], text: str, word: str = "word") -> DataFrame:
    """One row per kept word: lower case, 2 to 15 characters, no leading underscore."""
    return df.select(*keep, F.explode(word_runs(F.col(text))).alias(word)).where(is_word(word))


def explode_article_words(
    articles: DataFrame, keys: list[str], mark_articles: bool = False
) -> DataFrame:
    """Words of both fields: ``(keys, field, word)`` with field ``title`` or ``abstract``.

    With ``mark_articles`` each article also gives one row with an empty word and no field.
    """
    fields = [
        F.struct(F.lit(name).alias("field"), word_runs(F.col(name)).alias("words"))
        for name in ("title", "abstract")
    ]
    if mark_articles:
        fields.append(
            F.struct(F.lit(None).cast("string").alias("field"), F.array(F.lit("")).alias("words"))
        )
    rows = articles.select(*keys, F.inline(F.array(*fields)))
    words = rows.select(*keys, "field", F.explode("words").alias("word"))
    return words.where((F.col("word") == "") | is_word("word")) if mark_articles else words.where(
        is_word("word")
    )


def record_text(
    is_book: Column, pmid: Column, title: Column, abstract: Column, book_title: Column
) -> Column:
    """Display text of a record, in the book or the article shape (fixed formats)."""
    return F.when(
        is_book,
        F.format_string(
            "PMID: %s\nBook Title: %s\nChapter Title: %s\nAbstract: %s",
            pmid, book_title, title, abstract,
        ),
    ).otherwise(F.format_string("PMID: %s\nTitle: %s\nAbstract: %s", pmid, title, abstract))
