"""Articles to vectors: mean word vector of the title beside that of the abstract."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from reviewsieve.functions.hashing import draw
from reviewsieve.functions.ranking import draw_rank
from reviewsieve.functions.text import explode_article_words, kept_words
from reviewsieve.session import broadcast_if_small, cut_lineage, fresh

FIELDS = ("title", "abstract")
# Word vectors that may be broadcast, in memory and as doubles: the driver holds them several times.
VECTORS_MAX_BYTES = 32 * 1024 * 1024
# Texts with their vectors and sums that make a block, and word vectors that a task holds.
BLOCK_BYTES = 64 * 1024 * 1024
# Words of a block whose vectors are laid out at once.
WORDS_AT_ONCE = 1 << 15


def word_counts(articles: DataFrame, keys: list[str]) -> DataFrame:
    """Per word and field: how often it occurs and in how many articles.

    An article of one row counts its words where it is, so only counts per word are shuffled.
    Rows with the same keys are one article: where keys repeat, these rows (and no others) send
    their words to be counted per article first.
    """
    key = F.struct(*keys).alias("_key")
    repeated = cut_lineage(
        articles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(key)
    )
    several = repeated.limit(1).count() > 0
    alone = articles
    if several:
        keyed = articles.withColumn("_key", key)
        few = broadcast_if_small(repeated)
        alone = keyed.join(few, "_key", "left_anti").drop("_key")
    # Each word of a field twice: once for the article, and once for every occurrence.
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    fields = [F.struct(F.lit(f).alias("field"), kept_words(F.col(f)).alias("words")) for f in FIELDS]
    each = F.concat(
        F.transform(
            F.array_distinct("words"),
            lambda w: F.struct(w.alias("word"), one.alias("articles"), none.alias("occurrences")),
        ),
        F.transform(
            "words", lambda w: F.struct(w.alias("word"), none.alias("articles"), one.alias("occurrences"))
        ),
    )
    counts = alone.select(F.inline(F.array(*fields))).select("field", F.inline(each))
    if several:
        words = explode_article_words(keyed.join(few, "_key", "left_semi").drop("_key"), keys)
        per_article = words.groupBy(*keys, "field", "word").agg(F.count(F.lit(1)).alias("occurrences"))
        counts = counts.unionByName(per_article.select("field", "word", one.alias("articles"), "occurrences"))
    return counts.groupBy("field", "word").agg(
        F.sum("articles").alias("articles"), F.sum("occurrences").alias("occurrences")
    )


def vocabulary_stats(vectors: DataFrame) -> tuple[int, int]:
    """Width of the word vectors (the same in every row) and bytes of the whole table in memory."""
    row = vectors.agg(
        F.min(F.size("vector")).alias("lo"),
        F.max(F.size("vector")).alias("hi"),
        F.sum(F.octet_length("word") + F.size("vector") * F.lit(8).cast("bigint") + 100).alias("bytes"),
    ).first()
    if row.lo is None or row.lo != row.hi:
        raise ValueError(f"word vectors need one width, found {row.lo} to {row.hi}")
    return row.hi, row.bytes


def document_vectors(
    articles: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    max_broadcast_bytes: int = VECTORS_MAX_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``features array<double>`` of twice the vector width per article.

    Words without a vector are left out; a field without any known word gives zeros.
    ``vectors`` has one row per word and is measured first. Below the limit it is broadcast, and
    words meet vectors inside the scan's own tasks. A larger vocabulary never goes through the
    driver: articles are dealt into blocks of about ``block_bytes``, every block is sent the
    vectors of its own words, once each, and sums them up in one task. So the texts are read a
    fixed number of times, however many words there are, and what is sent follows the texts.
    """
    size, total = vocabulary_stats(vectors)
    vectors = vectors.select("word", "vector")
    if total > max_broadcast_bytes:
        sums = _sums_by_block(articles, vectors, keys, size, total, block_bytes)
        return _means(sums, keys, size)
    # Every article gives one empty word without a field, and that word a vector of zeros:
    # so an article without any known word stays, without a second look at the articles.
    words = explode_article_words(articles, keys, mark_articles=True)
    empty = vectors.sparkSession.range(1).select(
        F.lit("").alias("word"), F.array_repeat(F.lit(0.0).cast("float"), size).alias("vector")
    )
    rows = vectors.unionByName(empty).select("word", array_to_vector("vector").alias("vector"))
    found = words.join(F.broadcast(rows), "word")
    sums = found.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("n"), _total("vector")
    ).select(*keys, "field", "n", F.col("_s.sum").alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), size)

    def mean(field: str) -> Column:
        one = F.max(F.when(F.col("field") == field, F.struct("n", vector_to_array("vector"))))
        return F.coalesce(F.transform(one["col2"], lambda x: x / one["n"]), zeros)

    return sums.groupBy(*keys).agg(F.concat(mean("title"), mean("abstract")).alias("features"))


def _total(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return Summarizer.metrics("sum").summary(column).alias("_s")


def _sums_by_block(
    articles: DataFrame, vectors: DataFrame, keys: list[str], size: int, total: int, block_bytes: int
) -> DataFrame:
    """Per article row: known words of both fields (``_n``) and the sums of their vectors, one
    behind the other (``_sums``).

    A block is bounded by its texts, by the vectors these may ask for and by the sums it returns.
    Vectors are dealt by word into parts of ``block_bytes``, which a task holds while the words of
    the blocks pass by; a word passes once for every block that has it.
    """
    texts = [F.coalesce(F.octet_length(field), F.lit(0)).cast("bigint") for field in FIELDS]
    weight = sum(texts[1:], texts[0]) * (1 + size // 64) + 16 * size
    weighed = articles.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first().bytes
    blocks = max(1, math.ceil(weighed / block_bytes))
    parts = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64(*keys, *FIELDS), F.lit(blocks)).cast("int").alias("_block")
    dealt = articles.select(*keys, *FIELDS, block).repartition(blocks, "_block")
    used = explode_article_words(dealt, ["_block"]).select("_block", "word").distinct()
    sent = used.repartition(parts, "word").join(
        vectors.repartition(parts, "word").hint("shuffle_hash"), "word"
    )
    words = dealt.select(*keys, "_block", *[kept_words(F.col(f)).alias(f"_{f}") for f in FIELDS])
    schema = StructType(
        [*[articles.schema[k] for k in keys], StructField("_n", ArrayType(LongType())),
         StructField("_sums", ArrayType(DoubleType()))]
    )
    sent = fresh(sent).repartition(blocks, "_block")
    cells = words.groupBy("_block").cogroup(sent.groupBy("_block"))
    return cells.applyInArrow(_block_sums(keys, size), schema)


def _block_sums(keys: list[str], size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums of the vectors of every article of a block."""

    def run(articles: pa.Table, known: pa.Table) -> pa.Table:
        words, matrix, times = _matrix(known, size)
        both = [_field_sums(articles[f"_{f}"].combine_chunks(), words, matrix, times) for f in FIELDS]
        columns = [articles[k] for k in keys]
        for values in (np.stack([n for n, _ in both], axis=1), np.hstack([sums for _, sums in both])):
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))
        return pa.table(columns, names=[*keys, "_n", "_sums"])

    return run


def _matrix(known: pa.Table, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, their vectors row by row, and how many vectors each has (all of them are added up)."""
    vectors = known["vector"].combine_chunks()
    values = vectors.flatten()
    if vectors.null_count or values.null_count:
        raise ValueError("word vectors need values, found null")
    matrix = values.to_numpy().reshape(-1, size)
    coded = known["word"].combine_chunks().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    if len(words) < len(codes):
        summed = np.zeros((len(words), size))
        np.add.at(summed, codes, matrix)
        matrix = summed
    return words, matrix, np.bincount(codes, minlength=len(words)).astype(np.int64)


def _field_sums(
    texts: pa.Array, words: pa.Array, matrix: np.ndarray, times: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per text of a field: how many known words it has, and the sum of their vectors."""
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
    at = pc.index_in(texts.flatten(), value_set=words).fill_null(-1).to_numpy()
    owner, at = owner[at >= 0], at[at >= 0]
    n = np.zeros(len(texts), np.int64)
    sums = np.zeros((len(texts), matrix.shape[1]))
    for begin in range(0, len(at), WORDS_AT_ONCE):
        whose, which = owner[begin : begin + WORDS_AT_ONCE], at[begin : begin + WORDS_AT_ONCE]
        first = np.flatnonzero(np.diff(whose, prepend=-1))
        n[whose[first]] += np.add.reduceat(times[which], first)
        sums[whose[first]] += np.add.reduceat(matrix[which].astype(np.float64), first, axis=0)
    return n, sums


def _means(sums: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Mean vectors per article; rows of the same keys are one article."""
    n = [F.sum(F.get("_n", F.lit(i))).alias(f"_n{i}") for i in range(len(FIELDS))]
    whole = sums.groupBy(*keys).agg(*n, _total(array_to_vector("_sums")))
    whole = whole.withColumn("_v", vector_to_array("_s.sum"))

    def mean(i: int) -> Column:
        own = F.slice("_v", i * size + 1, size)
        return F.transform(own, lambda x: F.when(F.col(f"_n{i}") > 0, x / F.col(f"_n{i}")).otherwise(0.0))

    return whole.select(*keys, F.concat(*[mean(i) for i in range(len(FIELDS))]).alias("features"))


def shuffled_articles(
    articles: DataFrame, topic: str = "topic", pmid: str = "pmid", seed: int = 42
) -> DataFrame:
    """Articles with ``pos``, their place in a seeded random order of their topic."""
    drawn = articles.withColumn("_draw", draw(seed, pmid))
    return draw_rank(drawn, [topic], "_draw", [pmid], "pos").drop("_draw")
