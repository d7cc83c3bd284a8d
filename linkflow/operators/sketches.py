"""Degree statistics from mergeable quantile sketches (opt-in, for large data).

The exact statistics (:mod:`linkflow.operators.stats`) read every degree each
time. Here each group of pages (a day's crawl, a slice of the pages) gives one
row: a KLL sketch of its degrees and the exact count, sum, least and greatest.
Such rows merge at will, over partitions and over days, so a new day costs its
own pages and the rows of the days before, not their pages.

Rank error: a value that the merged sketch gives for percentile p has a true
rank within ``rank_error(k)`` of p, with 99 % confidence for each percentile
(the bound that the sketch's authors state; it does not grow with merging or
with the data). Count, mean, least and greatest are exact. The values are
degrees that occur, not interpolated ones.

Nulls are no degrees; no degrees at all give a count of 0 and NULL statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.operators.stats import QUINTILES

# The sketch's size parameter: about 3 * K degrees are kept, however many there are.
K = 1024
PERCENTILES = {"median": 0.5} | {f"p{int(p * 100)}": p for p in QUINTILES}


def rank_error(k: int = K) -> float:
    """The stated error of a rank, as a share of all pages (0.27 % at K)."""
    return 2.296 / k ** 0.9723


def degree_sketches(degrees: DataFrame, col: str, groups: list[str], k: int = K) -> DataFrame:
    """``(*groups, pages, total, min, max, sketch)``: a row for each group. The
    sketches of one group are built in every task and merged, so a hot group
    sends a sketch a task, not its rows."""
    d = F.col(col).cast("bigint")
    return degrees.where(d.isNotNull()).groupBy(*groups).agg(
        F.count(d).alias("pages"), F.sum(d).alias("total"), F.min(d).alias("min"),
        F.max(d).alias("max"), F.kll_sketch_agg_bigint(d, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, groups: list[str] = (), k: int = K) -> DataFrame:
    """The same columns with the rows of each of ``groups`` merged (all, without)."""
    return sketches.groupBy(*groups).agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.sum("total").alias("total"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.kll_merge_agg_bigint(F.col("sketch"), F.lit(k)).alias("sketch"))


def percentile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(p))


def sketch_stats(sketches: DataFrame, groups: list[str] = (), k: int = K) -> DataFrame:
    """``(*groups, pages, avg, max, min, median, p20, p40, p60, p80)``."""
    return merged(sketches, groups, k).select(
        *groups, "pages", (F.col("total") / F.col("pages") if groups else F.when(F.col("pages") > 0, F.col("total") / F.col("pages"))).alias("avg"),
        "max", "min", *(F.when(F.col("pages") > 0, percentile(F.col("sketch"), p)).alias(name) for name, p in PERCENTILES.items()))


def within_error(stats: DataFrame, degrees: DataFrame, col: str, error: float) -> DataFrame:
    """``(statistic, within)`` for each percentile of one row of ``stats``:
    whether its true rank, from all ``degrees``, is within ``error``. The shares
    of degrees below and up to a value bracket its rank."""
    p = F.create_map(*(F.lit(x) for item in PERCENTILES.items() for x in item))
    asked = stats.select(F.explode(F.create_map(*(x for name in PERCENTILES for x in (F.lit(name), F.col(name))))).alias("statistic", "value"))
    hist = degrees.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("d")).agg(F.count(F.lit(1)).alias("w"))
    # each degree adds to every statistic
    each = hist.withColumn("statistic", F.explode(F.array(*map(F.lit, PERCENTILES))))
    sums = each.join(F.broadcast(asked), "statistic").groupBy("statistic").agg(
        F.sum("w").alias("all"), F.coalesce(F.sum(F.when(F.col("d") < F.col("value"), F.col("w"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("d") <= F.col("value"), F.col("w"))), F.lit(0)).alias("upto"))
    rank = p[F.col("statistic")]
    near = (F.col("below") / F.col("all") <= rank + error) & (F.col("upto") / F.col("all") >= rank - error)
    return sums.select("statistic", near.alias("within"))
