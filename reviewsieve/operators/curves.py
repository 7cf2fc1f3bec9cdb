"""Curves over a reveal log: recall, feature coverage, areas, and bands across runs.

A curve has one row per round: ``topic, policy, run, round`` and values in percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import sums_before, with_previous
from reviewsieve.operators.pool import RUN

GRID_CHUNK = 4096
# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom, and
# that of the normal distribution.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836,
    2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546,
    2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553,
    2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)
Z_975 = 1.959963984540054


def recall_curve(
    log: DataFrame,
    judged: DataFrame,
    count_seeds: bool = False,
    include_final: bool = False,
) -> DataFrame:
    """Effort and recall per round, as they stood before the round's own reveal.

    Effort is the labelled share of the topic, recall the found share of its included
    articles (label 1; null if it has none). Seeds count as effort, and as found only with
    ``count_seeds``. ``include_final`` adds the state after the last round.
    """
    hit = F.col("label") == 1
    if not count_seeds:
        hit = hit & (F.col("round") > 0)
    rounds = log.groupBy(*RUN, "round").agg(
        F.count(F.lit(1)).alias("revealed"), F.count_if(hit).alias("hits")
    )
    if include_final:
        last = rounds.groupBy(*RUN).agg((F.max("round") + 1).alias("round"))
        zero = F.lit(0).cast("bigint")
        rounds = rounds.unionByName(last.select("*", zero.alias("revealed"), zero.alias("hits")))
    state = sums_before(rounds, RUN, "round", {"labelled": "revealed", "found": "hits"})
    totals = judged.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("label") == 1).alias("n_included")
    )
    effort = 100.0 * F.col("labelled") / F.col("n_all")
    recall = 100.0 * F.col("found") / F.nullif(F.col("n_included"), F.lit(0))
    return state.where(F.col("round") > 0).join(totals, "topic").select(
        *RUN, "round", "labelled", "found",
        effort.alias("effort_pct"), recall.alias("recall_pct"),
    )


def curve_areas(
    curve: DataFrame, areas: dict[str, str], x: str = "effort_pct", step: str = "round"
) -> DataFrame:
    """Areas under each run's curves by the trapezoid rule; ``areas`` maps name to curve."""
    ys = list(areas.values())
    pairs = with_previous(curve.select(*RUN, step, x, *ys), RUN, step, [x, *ys])

    def area(y: str) -> Column:
        slab = (F.col(x) - F.col(f"prev_{x}")) * (F.col(y) + F.col(f"prev_{y}")) / 2
        whole = F.count_if(F.col(y).isNull()) == 0
        return F.when(whole, F.coalesce(F.sum(slab), F.lit(0.0)))

    return pairs.groupBy(*RUN).agg(*[area(y).alias(name) for name, y in areas.items()])


def curve_auc(curve: DataFrame, y: str, x: str = "effort_pct", name: str = "auc") -> DataFrame:
    """Area under one curve of each run."""
    return curve_areas(curve, {name: y}, x)


def policy_summary(areas: DataFrame) -> DataFrame:
    """Mean areas per topic and policy, with the fixed-width line of a printed table.

    ``areas`` carries ``auc_recall`` and ``auc_coverage`` per run.
    """
    means = areas.groupBy("topic", "policy").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("auc_recall").alias("auc_recall"),
        F.avg("auc_coverage").alias("auc_coverage"),
    )
    line = F.format_string("%-20s | %13.2f | %25.2f", "policy", "auc_recall", "auc_coverage")
    return means.withColumn("line", line)


def curve_grid(curve: DataFrame, y: str, x: str = "effort_pct", step: str = "round") -> DataFrame:
    """Each run's curve read off an even grid over 0 to 100: ``grid, grid_x, y``.

    A topic and policy share one grid, as long as their longest run. Between two points the
    curve is linear, outside it keeps its first and last value. Every point hands out the
    grid places of the stretch that ends in it, so grid and curve are never sorted together.
    """
    points = with_previous(curve.select(*RUN, step, x, y), RUN, step, [x, y])
    lengths = curve.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"), F.max(step).alias("_last"))
    longest = lengths.groupBy("topic", "policy").agg(F.max("_n").alias("_size"))
    sized = points.join(lengths.join(longest, ["topic", "policy"]), RUN)
    gap = F.col("_size") - 1
    place = lambda v: F.when(gap > 0, F.col(v) * gap / 100.0).otherwise(0.0)
    first = F.col(f"prev_{x}").isNull()
    last = F.col(step) == F.col("_last")
    # One place more on either side than the stretch needs; exact bounds are tested below.
    low = F.when(first, F.lit(0)).otherwise(F.greatest(F.floor(place(f"prev_{x}")) - 1, F.lit(0)))
    high = F.when(last, gap).otherwise(F.least(F.ceil(place(x)) + 1, gap))
    chunked = (
        sized.withColumn("_low", low.cast("bigint")).withColumn("_high", high.cast("bigint"))
        .where("_low <= _high")
        .withColumn("_chunk", F.explode(F.sequence(
            F.floor(F.col("_low") / F.lit(GRID_CHUNK)), F.floor(F.col("_high") / F.lit(GRID_CHUNK))
        )))
    )
    start = F.greatest("_low", F.col("_chunk") * GRID_CHUNK)
    stop = F.least("_high", F.col("_chunk") * GRID_CHUNK + (GRID_CHUNK - 1))
    placed = chunked.withColumn("grid", F.explode(F.sequence(start, stop))).withColumn(
        "grid_x", F.when(gap > 0, F.col("grid") * 100.0 / gap).otherwise(0.0)
    )
    after = first | (F.col("grid_x") > F.col(f"prev_{x}"))
    until = last | (F.col("grid_x") <= F.col(x))
    slope = (F.col(y) - F.col(f"prev_{y}")) / (F.col(x) - F.col(f"prev_{x}"))
    value = F.when(first | (F.col("grid_x") >= F.col(x)), F.col(y)).otherwise(
        F.col(f"prev_{y}") + slope * (F.col("grid_x") - F.col(f"prev_{x}"))
    )
    return placed.where(after & until).select(*RUN, "grid", "grid_x", value.alias(y))


def t_975(df: Column) -> Column:
    """95 % point of Student's t: the table, beyond it the normal point with corrections."""
    z = Z_975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    )
    series = F.lit(z)
    for power, term in enumerate(terms, start=1):
        series = series + F.lit(term) / F.pow(df.cast("double"), F.lit(float(power)))
    table = F.array(*[F.lit(t) for t in T_975])
    return F.when(df <= len(T_975), F.get(table, (df - 1).cast("int"))).otherwise(series)


def curve_band(grid: DataFrame, y: str) -> DataFrame:
    """Mean and 95 % interval across the runs at each grid place; null bounds for one run."""
    runs = F.count(F.col(y))
    stats = grid.groupBy("topic", "policy", "grid", "grid_x").agg(
        runs.alias("runs"),
        F.avg(y).alias("mean"),
        (F.stddev_samp(y) / F.sqrt(runs)).alias("sem"),
    )
    half = F.when(F.col("runs") > 1, t_975(F.col("runs") - 1) * F.col("sem"))
    return stats.select(
        "*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high")
    )
