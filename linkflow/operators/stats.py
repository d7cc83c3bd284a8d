"""Degree statistics: mean, max, min, median and the 20/40/60/80 percentiles.

Percentiles are exact with linear interpolation (the numpy default). They are
taken over the degree histogram ``(degree, pages)``: the histogram is a hash
aggregate with a map-side step, and the exact percentile then needs memory for
the distinct degree values only, however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUINTILES = (0.2, 0.4, 0.6, 0.8)


def degree_stats(degrees: DataFrame, col: str) -> DataFrame:
    """One row: ``pages, avg, max, min, median, p20, p40, p60, p80``.

    On empty input the count is 0 and every statistic NULL.
    """
    hist = degrees.groupBy(F.col(col).alias("d")).agg(F.count(F.lit(1)).alias("w"))
    pct = F.percentile(F.col("d"), F.array(*[F.lit(p) for p in (0.5,) + QUINTILES]), F.col("w"))
    total = F.sum("w")
    out = hist.agg(
        F.coalesce(total, F.lit(0)).alias("pages"),
        (F.sum(F.col("d") * F.col("w")) / total).alias("avg"),
        F.max("d").alias("max"),
        F.min("d").alias("min"),
        pct.alias("_pct"))
    return out.select(
        "pages", "avg", "max", "min",
        F.col("_pct")[0].alias("median"),
        *[F.col("_pct")[i + 1].alias(f"p{int(p * 100)}") for i, p in enumerate(QUINTILES)])
