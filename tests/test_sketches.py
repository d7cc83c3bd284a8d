"""Mergeable quantile sketches against exact ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkflow.operators import sketches as SK


def ranks(values, x):
    v = np.asarray(values)
    return (v < x).mean(), (v <= x).mean()


@pytest.mark.parametrize("k", [200, SK.K])
def test_merged_sketches_keep_the_rank_error(spark, k):
    rng = np.random.default_rng(1)
    values = np.floor(rng.pareto(1.2, 200_000) * 10).astype(int).tolist()
    df = spark.createDataFrame([(v, i % 50) for i, v in enumerate(values)], "d BIGINT, day INT")
    sketches = SK.degree_sketches(df, "d", ["day"], k)
    assert sketches.count() == 50
    r = SK.sketch_stats(sketches, k=k).first()
    assert (r.pages, r.min, r.max) == (len(values), min(values), max(values)) and r.avg == pytest.approx(np.mean(values))
    for name, p in SK.PERCENTILES.items():
        below, upto = ranks(values, r[name])
        assert below - SK.rank_error(k) <= p <= upto + SK.rank_error(k), name


def test_a_new_day_merges_with_the_days_before(spark, tmp_dir):
    """Old days are read as sketches only; merging in two steps keeps the error."""
    path = f"file://{tmp_dir}/sketches"
    every = []
    for day in range(4):
        values = [(v * (day + 1)) % 9973 for v in range(20_000)]
        every += values
        df = spark.createDataFrame([(v, day) for v in values], "d BIGINT, day INT")
        SK.degree_sketches(df, "d", ["day"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    halves = SK.merged(stored.withColumn("half", F.col("day") % 2), ["half"])
    r = SK.sketch_stats(halves).first()
    assert r.pages == len(every) == 80_000
    for name, p in SK.PERCENTILES.items():
        below, upto = ranks(every, r[name])
        assert below - SK.rank_error() <= p <= upto + SK.rank_error()
    by_day = {x.day: x.pages for x in SK.sketch_stats(stored, ["day"]).collect()}
    assert by_day == dict.fromkeys(range(4), 20_000)


def test_a_hot_group_sends_sketches_not_rows(spark):
    """The shuffle of one group's million rows carries a row a task."""
    df = spark.range(1_000_000, numPartitions=4).select(F.lit(1).alias("day"), (F.col("id") % 1000).alias("d"))
    plan = SK.degree_sketches(df, "d", ["day"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_kll_sketch_agg") >= 1, plan


def test_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (3, 1), (None, 2)], "d BIGINT, day INT")
    r = SK.sketch_stats(SK.degree_sketches(df, "d", ["day"])).first()
    assert (r.pages, r.median, r.max) == (1, 3, 3)
    r = SK.sketch_stats(SK.degree_sketches(df.limit(0), "d", ["day"])).first()
    assert (r.pages, r.avg, r.median, r.max) == (0, None, None, None)


def test_a_wrong_percentile_is_told(spark):
    df = spark.range(1000).withColumnRenamed("id", "d")
    stats = spark.createDataFrame([(500, 200, 400, 700, 800)], "median BIGINT, p20 BIGINT, p40 BIGINT, p60 BIGINT, p80 BIGINT")
    got = dict(map(tuple, SK.within_error(stats, df, "d", 0.01).collect()))
    assert got == {"median": True, "p20": True, "p40": True, "p60": False, "p80": True}
