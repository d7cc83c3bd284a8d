"""Forests grown in tasks: cuts and trees by brute force, tops against whole trees, size in the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkflow.operators import features as FT
from linkflow.operators import forest as FO
from linkflow.operators import models as M


def _score(y, w, classes):
    n = np.bincount(y, w, classes)
    return (n ** 2).sum() / n.sum() if n.sum() else np.nan


def test_best_cuts_are_those_of_brute_force():
    rng, bins = np.random.default_rng(1), 8
    for trial in range(60):
        slots, classes, n = rng.integers(1, 5), rng.integers(2, 6), 80
        slot = np.concatenate([np.arange(slots), rng.integers(0, slots, n)])
        x, w = rng.integers(0, bins, len(slot)), rng.integers(1, 400 if trial % 4 else 4, len(slot))
        y = (x > 3).astype(int) if trial % 3 == 0 else rng.integers(0, classes, len(slot))
        gains, cuts = FO.best_cuts(*FO.counted((slot * classes + y) * bins + x, w), classes, bins)
        for s in range(slots):
            here = slot == s
            whole = _score(y[here], w[here], classes)
            at = [_score(y[here & (x <= b)], w[here & (x <= b)], classes) + _score(y[here & (x > b)], w[here & (x > b)], classes) - whole for b in range(bins)]
            best = np.nanmax([*at, -np.inf])
            if best > 1e-9:
                assert gains[s] == pytest.approx(best) and cuts[s] == next(b for b, v in enumerate(at) if v > best - 1e-9)
            else:
                assert gains[s] == -1


def test_a_grown_tree_tells_rows_apart_as_far_as_its_features_do():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 16, (2, 4000)).astype(np.uint8)             # both are drawn at each node
    y, w = (x[0].astype(int) * 3 + x[1]) % 5, rng.integers(1, 4, 4000)
    tree = FO.grown(x, y, w, 0, 1, FO.Rules(2, 5, 16, 30, 0))
    row, classes, shares = tree.votes(tree.leaves(x))
    assert np.bincount(row, shares) == pytest.approx(np.ones(4000))          # shares of a leaf
    assert (y[row[shares > 0.5]] == classes[shares > 0.5]).mean() > 0.99
    assert FO.grown(x, y, w, 0, 1, FO.Rules(2, 5, 16, 4, 0)).heap.max() < 32   # no deeper than asked
    same = FO.grown(np.zeros((3, 9), np.uint8), np.arange(9) % 2, np.ones(9, int), 0, 1, FO.Rules(3, 2, 16, 30, 0))
    assert same.feature.tolist() == [-1] and same.shares == pytest.approx([5 / 9, 4 / 9])


def _frame(spark, rows):
    """Half of the rows are alike in all features; ids repeat and some are null."""
    f = [f"cast(if(id % 2 = 0, 7, pmod(hash(id, {k}), 90)) AS double) AS f{k}" for k in range(4)]
    frame = spark.range(rows).selectExpr("if(id % 10 = 0, null, id div 2) AS request_id", "id", *f)
    return frame.withColumn("c", F.when(F.col("id") % 2 == 0, F.col("id") % 6 / 2).otherwise(
        F.floor((F.col("f1") + F.col("f2")) / 40)).cast("double")).drop("id")


def test_tops_from_counts_and_trees_from_rows_are_the_same_forest(spark):
    """A tree is the same wherever its nodes are split, however the rows came, with blocks of any size."""
    names, frame = ["f0", "f1", "f2", "f3"], _frame(spark, 6000)
    key = ["request_id", "c", *names]
    whole = FO.fit(frame, names, "c", 5, 5, 6000)
    assert [t.feature.tolist() for t in whole.tops] == [[-1]] * 5
    was = sorted(map(str, whole.score(frame, key).collect()))
    for depth in (30, 3):
        cut = FO.fit(frame.repartition(7), names, "c", 5, 5, 6000, max_depth=depth, local_rows=300)
        assert all(len(t.feature) > 5 for t in cut.tops)
        # rows alike in all features are a leaf that the driver has as counts, not rows for a task
        known = [np.diff(t.first) > 0 for t in cut.tops]
        assert depth == 3 or all(k.any() for k in known)
        if depth == 3:
            was = sorted(map(str, FO.fit(frame, names, "c", 5, 5, 6000, max_depth=3).score(frame, key).collect()))
        assert sorted(map(str, cut.score(frame.repartition(5), key).collect())) == was
    got = whole.score(frame, ["c", "f0"]).where("f0 != 7")
    assert M.accuracy(got.withColumnRenamed("c", "label")) > 0.9


def test_null_features_and_labels_fail_as_in_pyspark_ml(spark):
    frame = spark.range(50).selectExpr("id AS request_id", "cast(id % 2 AS double) AS c", "if(id = 7, null, id * 1.0D) AS f")
    with pytest.raises(Exception, match="null or NaN"):
        FO.fit(frame, ["f"], "c", 2, 2, 50)
    with pytest.raises(Exception, match="label f has null"):
        FO.fit(frame, ["c"], "f", 2, 2, 50)


def test_country_forest_of_many_rows_is_not_kept_by_the_driver(spark):
    """pyspark.ml has all nodes of all trees in the driver."""
    frame = spark.range(30_000).selectExpr("id AS request_id", "id % 900 div 180 AS country", "id % 900 div 30 AS ip_1",
                                           "id % 30 AS ip_2", "0 AS ip_3", "cast(rand(3) * 255 AS int) AS ip_4").checkpoint()
    run = M.model_country(frame)
    assert isinstance(run.model, FO.Forest) and sum(len(t.feature) for t in run.model.tops) == 50
    assert run.predictions.columns == ["request_id", "label", "prediction"] and run.accuracy > 0.9
    test = frame.where(~FT.split_flag()).selectExpr("request_id", "cast(country AS double) AS label")
    assert run.predictions.select("request_id", "label").exceptAll(test).count() == 0 and run.predictions.count() == test.count()
    few = M.model_country(frame.where("request_id < 3000"))
    assert not isinstance(few.model, FO.Forest)


def test_income_forest_of_many_rows_is_not_kept_by_the_driver(spark):
    """Every feature but the income and the id goes into the trees, booleans as well."""
    frame = spark.range(20_000).selectExpr("id AS request_id", "id % 12 < 3 AS is_banned", "id % 40 AS file_name", "hash(id) % 1000 AS time",
                                           "id % 12 AS country", "if(id % 12 < 3, 0, if(id % 2 = 0, 1 + id % 40 div 8, 6)) AS income",
                                           "id % 2 = 0 AS gender_Male", "id % 2 = 1 AS gender_Female").checkpoint()
    run = M.model_income(frame)
    assert isinstance(run.model, FO.Forest) and sum(len(t.feature) for t in run.model.tops) == 55
    assert run.model.features == ["is_banned", "file_name", "time", "country", "gender_Male", "gender_Female"]
    test = frame.where(~FT.split_flag()).selectExpr("request_id", "cast(income AS double) AS label")
    assert run.predictions.select("request_id", "label").exceptAll(test).count() == 0 and run.predictions.count() == test.count()
    assert run.accuracy > 0.95
    again = M.model_income(frame.repartition(3))          # the same rows in another order
    assert again.predictions.exceptAll(run.predictions).count() == 0
