"""Fixed-decimal rendering for reports (applied at the edge, on small results)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_DECIMALS = 12
STAT_DECIMALS = 4


def fixed(value: Column, decimals: int) -> Column:
    """``value`` as text with exactly ``decimals`` digits after the point."""
    return F.format_string(f"%.{decimals}f", value)


def rank_report(top: DataFrame) -> DataFrame:
    """``Rank <n>: <page>, Score <rank .12f>`` lines of a numbered top list."""
    return top.orderBy("position").select(F.format_string(
        "Rank %d: %s, Score %s", F.col("position"), F.col("page"),
        fixed(F.col("rank"), RANK_DECIMALS)).alias("line"))


def stats_report(stats: DataFrame, label: str) -> DataFrame:
    """Degree statistics as report lines: averages and percentiles at .4f."""
    row = stats.select(
        F.format_string(f"Average {label} Links: %s", fixed(F.col("avg"), STAT_DECIMALS)).alias("a"),
        F.format_string(f"Max {label}: %s", F.col("max").cast("string")).alias("b"),
        F.format_string(f"Min {label}: %s", F.col("min").cast("string")).alias("c"),
        F.format_string(f"Median {label}: %s", F.col("median").cast("string")).alias("d"),
        *[F.format_string(f"{p}th Percentile: %s", fixed(F.col(f"p{p}"), STAT_DECIMALS)).alias(f"q{p}")
          for p in (20, 40, 60, 80)])
    return row.select(F.explode(F.array(*row.columns)).alias("line"))
