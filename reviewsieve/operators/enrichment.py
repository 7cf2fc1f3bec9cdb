"""Judgements with the title and abstract of their articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.joins import HOT_MIN_ROWS, hot_keys, last_version
from reviewsieve.session import broadcast_if_small, cut_lineage

# Records with their texts that may be broadcast at once.
HOT_RECORDS = 10_000
# Records of a later batch that may be broadcast at once.
BATCH_RECORDS = 50_000


def enrich_judgements(
    judged: DataFrame,
    records: DataFrame,
    seq: str = "seq",
    hot_rows: int = HOT_MIN_ROWS,
    keep_seq: bool = False,
) -> DataFrame:
    """All judgements of all topics, left joined to the last record of their pmid.

    Which record is last is settled on ``(pmid, seq)`` alone, so the texts are shuffled
    once, and copies of one record spread by ``seq``. If some pmids are judged in very many
    rows, the last records of these are broadcast to the rows instead, if they are few.
    ``seq`` orders the records of one pmid and is unique among them; with ``keep_seq`` it stays,
    for batches that come later.
    """
    text = F.col("pmid").cast("string")
    columns = judged.columns
    judged = judged.withColumn("pmid", text)
    records = records.withColumn("pmid", text).select("pmid", "title", "abstract", seq)
    hot = hot_keys(judged, ["pmid"], hot_rows)
    rest = judged if hot is None else judged.join(hot, "pmid", "left_anti")
    last = records.groupBy("pmid").agg(F.max(seq).alias(seq))
    joined = rest.join(last, "pmid", "left").join(records, ["pmid", seq], "left")
    texts = ["title", "abstract", *([seq] if keep_seq else [])]
    joined = joined.select(*columns, *texts)
    if hot is None:
        return joined
    few = cut_lineage(last_version(records.join(hot, "pmid", "left_semi"), ["pmid"], seq))
    few = broadcast_if_small(few, HOT_RECORDS)
    spread = judged.join(hot, "pmid", "left_semi").join(few, "pmid", "left")
    return joined.unionByName(spread.select(*columns, *texts))


def with_later_records(enriched: DataFrame, records: DataFrame, seq: str = "seq") -> DataFrame:
    """Judgements that were enriched before (``keep_seq``), with a later batch of records.

    A record takes the place of an earlier one of its pmid, and of none; what is older than the one in
    place changes nothing. The result is that of ``enrich_judgements`` with all records, and can be
    given the next batch. Only the batch is shuffled, to its last records; judgements stay where
    they are if these are few, else both are shuffled once.
    """
    text = F.col("pmid").cast("string").alias("pmid")
    batch = records.select(text, "title", "abstract", seq)
    last = cut_lineage(last_version(batch, ["pmid"], seq)).select(
        "pmid", F.struct("title", "abstract", seq).alias("_new")
    )
    joined = enriched.join(broadcast_if_small(last, BATCH_RECORDS), "pmid", "left")
    newer = F.col("_new").isNotNull() & (F.col(seq).isNull() | (F.col(f"_new.{seq}") > F.col(seq)))
    kept = {c: F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "abstract", seq)}
    return joined.select(*[kept.get(c, F.col(c)) for c in enriched.columns])


def without_record(enriched: DataFrame) -> DataFrame:
    """Judgements for which no record was found."""
    return enriched.where(F.col("title").isNull() & F.col("abstract").isNull())
