"""Start pools and seed pools: small labelled sets that hold both classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.functions.hashing import draw
from reviewsieve.functions.ranking import first_k_drawn
from reviewsieve.session import broadcast_if_small, cut_lineage

TRIES = 10
# Rows of a class that are looked at per attempt, on average, to find its first ``size`` draws.
LOOKED_AT = 4
AT_LEAST = 24


def _class() -> Column:
    return F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(2)


def _stratified(judged: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per group: the first drawn row of class 0 and of class 1, then others up to ``size``.

    ``judged`` carries ``pmid, label, _draw``. Each class gives at most ``size`` rows to
    the last step, so a group there is at most three times that.
    """
    drawn = judged.withColumn("_class", _class())
    few = first_k_drawn(drawn, [*keys, "_class"], "_draw", ["pmid"], size, "_place")
    lead = (F.col("_place") == 1) & (F.col("_class") < 2)
    by_lead = Window.partitionBy(*keys).orderBy(
        F.desc(lead), F.when(lead, F.col("_class")), "_draw", "pmid"
    )
    return (
        few.withColumn("rank_in_round", F.row_number().over(by_lead))
        .where(F.col("rank_in_round") <= size)
        .select(*keys, "rank_in_round", "pmid", "label")
    )


def _low_draws(judged: DataFrame, first: int, last: int, size: int, seed: int) -> DataFrame:
    """``topic, attempt, pmid, label, _draw`` of rows with low draws in attempts ``first`` to ``last``.

    Among them are the first ``size`` of every class and attempt. Draws are uniform, so those
    lie below a limit that follows from the size of the class, and a row leaves the scan only for
    the attempts in which it is below it. Classes and attempts in which that gave too few rows
    are drawn again without a limit.
    """
    rows = judged.select("topic", "pmid", "label", _class().alias("_class"))
    sizes = cut_lineage(rows.groupBy("topic", "_class").agg(F.count(F.lit(1)).alias("_n")))
    share = F.lit(LOOKED_AT * size + AT_LEAST) / F.col("_n")
    # Draws are hex digits, so every draw is below this letter.
    digits = F.lower(F.lpad(F.hex(F.floor(share * F.lit(2.0**32)).cast("long")), 8, "0"))
    limit = F.when(share >= 1, F.lit("g")).otherwise(digits)
    groups = sizes.select(
        F.col("topic").alias("_topic"), F.col("_class").alias("_of"), "_n", limit.alias("_limit")
    )
    same = F.equal_null("topic", "_topic") & (F.col("_class") == F.col("_of"))
    limited = rows.join(broadcast_if_small(groups), same).drop("_topic", "_of")

    def drawn(rows: DataFrame, tries: Column) -> DataFrame:
        exploded = rows.select("topic", "pmid", "label", "_class", F.explode(tries).alias("attempt"))
        return exploded.withColumn("_draw", draw(seed, "attempt", "pmid"))

    every = F.sequence(F.lit(first), F.lit(last))
    low = F.filter(every, lambda a: draw(seed, a, "pmid") < F.col("_limit"))
    found = cut_lineage(drawn(limited, low))
    counts = found.groupBy("topic", "_class", "attempt").agg(F.count(F.lit(1)).alias("_found"))
    wanted = sizes.withColumn("attempt", F.explode(every)).alias("w")
    counts = counts.alias("c")
    met = (
        F.equal_null("w.topic", "c.topic")
        & (F.col("w._class") == F.col("c._class"))
        & (F.col("w.attempt") == F.col("c.attempt"))
    )
    missed = wanted.join(counts, met, "left").where(
        F.coalesce("_found", F.lit(0)) < F.least(F.col("_n"), F.lit(size))
    )
    missed = cut_lineage(missed.select(
        F.col("w.topic").alias("_topic"), F.col("w._class").alias("_of"), F.col("w.attempt").alias("_try")
    ))
    columns = ["topic", "attempt", "pmid", "label", "_draw"]
    if not missed.limit(1).count():
        return found.select(*columns)
    tries = missed.groupBy("_topic", "_of").agg(F.collect_list("_try").alias("_tries"))
    again = drawn(rows.join(broadcast_if_small(tries), same), F.col("_tries"))
    whole = F.equal_null("topic", "_topic") & (F.col("_class") == F.col("_of")) & (F.col("attempt") == F.col("_try"))
    kept = found.join(broadcast_if_small(missed), whole, "left_anti")
    return kept.select(*columns).unionByName(again.select(*columns))


def start_pool(
    judged: DataFrame, size: int = 1, seed: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """The first labelled rows per topic: one of class 0, one of class 1, then any.

    The pool has ``max(2, size)`` rows, fewer if the topic is smaller; a class that a
    topic lacks is skipped. Draws depend on ``keys`` only through the rows' ids.
    """
    keys = keys or ["topic"]
    drawn = judged.select(*keys, "pmid", "label", draw(seed, "pmid").alias("_draw"))
    return _stratified(drawn, keys, max(2, size))


def given_pool(judged: DataFrame, pool: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A pool of given ids ``(topic, rank_in_round, pmid)`` with labels; unknown ids fail."""
    keys = keys or ["topic"]
    unknown = pool.join(judged, [*keys, "pmid"], "left_anti").select("pmid").limit(20)
    missing = [row.pmid for row in unknown.collect()]
    if missing:
        raise ValueError(f"seed pool holds ids that are not in its topic: {missing}")
    return pool.join(judged.select(*keys, "pmid", "label"), [*keys, "pmid"]).select(
        *keys, "rank_in_round", "pmid", "label"
    )


def seed_pools(
    judged: DataFrame, num_pools: int, size: int = 2, seed: int = 0
) -> DataFrame:
    """``num_pools`` different pools per topic: ``(topic, pool_id, pmids, both_classes)``.

    Attempt a draws by ``md5(seed, a, pmid)``; rows are not copied per attempt (``_low_draws``). Equal pools are counted once, under the
    first attempt that gave them. ``num_pools`` attempts come first; only topics left
    short by equal pools are drawn again, up to ten attempts per pool.
    """

    size = max(2, size)

    def attempts(rows: DataFrame, first: int, last: int) -> DataFrame:
        rows = _stratified(_low_draws(rows, first, last, size, seed), ["topic", "attempt"], size)
        return rows.groupBy("topic", "attempt").agg(
            F.array_sort(F.collect_list("pmid")).alias("pmids"),
            ((F.count_if(F.col("label") == 0) > 0) & (F.count_if(F.col("label") == 1) > 0)).alias(
                "both_classes"
            ),
        )

    def distinct_pools(pools: DataFrame) -> DataFrame:
        return pools.groupBy("topic", "pmids").agg(
            F.min("attempt").alias("attempt"), F.first("both_classes").alias("both_classes")
        )

    first = attempts(judged, 0, num_pools - 1)
    short = (
        distinct_pools(first)
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < num_pools)
    )
    again = attempts(judged.join(short, "topic", "left_semi"), num_pools, TRIES * num_pools - 1)
    pools = distinct_pools(first.unionByName(again))
    by_attempt = Window.partitionBy("topic").orderBy("attempt")
    return (
        pools.withColumn("pool_id", F.row_number().over(by_attempt))
        .where(F.col("pool_id") <= num_pools)
        .select("topic", "pool_id", "attempt", "pmids", "both_classes")
    )


def short_topics(pools: DataFrame, num_pools: int) -> DataFrame:
    """Topics that gave fewer different pools than asked for."""
    return (
        pools.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("pools"))
        .where(F.col("pools") < num_pools)
    )
