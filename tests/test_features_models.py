"""Codes, IP octets, one-hot, split, forests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkflow.operators import features as FT
from linkflow.operators import models as M
from linkflow.plans.indexing import dense_index
from linkflow.plans.q_features import model_features


def test_codes_follow_first_appearance_not_frequency(spark):
    rows = [(1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, None), (6, "c"), (7, "b")]
    df = spark.createDataFrame(rows, "request_id BIGINT, country STRING")
    got = {r.request_id: r.country for r in FT.factorize(df, ["country"]).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 0}   # NULL gets its own code


def test_codes_of_several_columns_and_types(spark):
    import datetime as dt
    t1, t2 = dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 1)
    rows = [(10, "x", t1), (11, "y", t2), (12, "x", t2)]
    df = spark.createDataFrame(rows, "request_id BIGINT, income STRING, time TIMESTAMP")
    got = sorted(tuple(r) for r in FT.factorize(df, ["income", "time"]).select(
        "request_id", "income", "time").collect())
    assert got == [(10, 0, 0), (11, 1, 1), (12, 0, 1)]


def test_dense_index_distributed_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    small = {r["k"]: r["index"] for r in dense_index(df, "k", partitions=1).collect()}
    big = {r["k"]: r["index"] for r in dense_index(df, "k", partitions=7).collect()}
    assert small == big
    assert sorted(big.values()) == list(range(5000))
    assert sorted(big, key=big.get) == sorted(big)


def test_ip_octets_strict_and_lenient(spark):
    ok = spark.createDataFrame([("10.0.254.7",)], "ip_address STRING")
    assert tuple(FT.ip_octets(ok).first()) == (10, 0, 254, 7)
    bad = spark.createDataFrame([("1.2.3",), ("a.b.c.d",), (None,), ("1.2.3.4",)], "ip_address STRING")
    lenient = [tuple(r) for r in FT.ip_octets(bad, lenient=True).collect()]
    assert lenient == [(None,) * 4, (None,) * 4, (None,) * 4, (1, 2, 3, 4)]
    for value in ["1.2.3", "a.b.c.d", None]:
        df = spark.createDataFrame([(value,)], "ip_address STRING")
        with pytest.raises(Exception):
            FT.ip_octets(df).collect()


def test_onehot_null_gives_all_false(spark):
    df = spark.createDataFrame([(1, "Male"), (2, None), (3, "Female")], "request_id BIGINT, gender STRING")
    out = FT.onehot(df, ["gender"])
    assert out.columns == ["request_id", "gender_Female", "gender_Male"]
    got = {r.request_id: (r.gender_Female, r.gender_Male) for r in out.collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False)}


def test_split_is_deterministic_and_near_fraction(spark):
    df = spark.range(20000).withColumnRenamed("id", "request_id")
    a = df.repartition(3).where(FT.split_flag()).count()
    b = df.repartition(11).where(FT.split_flag()).count()
    assert a == b and 0.68 < a / 20000 < 0.72


def test_forests_run_and_learn_country(spark):
    frame = model_features(spark, "/root/testdata/sf0.01").checkpoint()
    country = M.model_country(frame)
    assert country.accuracy > 0.9          # octets identify the CIDR, hence the country
    assert country.predictions.columns == ["request_id", "label", "prediction"]
    income = M.model_income(frame)
    assert 0.0 <= income.accuracy <= 1.0
    assert "request_id" not in M.income_features(frame)
    assert "request_id" in M.income_features(frame, keep_id=True)


def test_codes_with_a_hot_value_and_nulls(spark):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"v{i % 50}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "request_id BIGINT, country STRING")
    first = {v: k for k, v in enumerate(dict.fromkeys(v for _, v in rows))}
    got = {r.request_id: r.country for r in FT.factorize(df, ["country"]).collect()}
    assert got == {i: first[v] for i, v in rows}


def test_onehot_has_no_level_cap(spark):
    df = spark.range(1500).selectExpr("id AS request_id", "concat('v', id) AS c")
    assert len(FT.onehot(df, ["c"]).columns) == 1501


def test_forest_of_197_classes(spark):
    df = spark.range(2000).selectExpr("id AS request_id", "id % 197 AS country", *(f"cast((id % 197 * {k}) % 256 AS int) AS ip_{k}" for k in range(1, 5)))
    run = M._run(df, M.COUNTRY_FEATURES, "country", 2, 0, "request_id", max_depth=6)
    assert 0.0 <= run.accuracy <= 1.0 and run.model.stages[-1].numClasses == 197


def test_dense_index_by_group_has_no_single_task_window(spark):
    df = spark.range(9000).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7919 % 100003).alias("k"))
    out = dense_index(df, "k", "i", "g", partitions=11)
    got = [tuple(r) for r in out.select("g", "k", "i").collect()]
    for g in range(3):
        own = sorted((k, i) for x, k, i in got if x == g)
        assert [i for _, i in own] == [*range(3000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan, plan
    assert dense_index(df.limit(0), "k").count() == 0


def test_factorize_plan_has_one_numbering_for_all_columns(spark):
    df = spark.range(2000).selectExpr("id AS request_id", "concat('a', id % 7) AS x", "concat('b', id % 1500) AS y", "if(id % 5 = 0, null, id % 3) AS z")
    out = FT.factorize(df, ["x", "y", "z"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan, plan
    rows = df.orderBy("request_id").collect()
    first = {c: {v: k for k, v in enumerate(dict.fromkeys(r[c] for r in rows))} for c in "xyz"}
    got = {r.request_id: (r.x, r.y, r.z) for r in out.collect()}
    assert got == {r.request_id: tuple(first[c][r[c]] for c in "xyz") for r in rows}


def test_onehot_vectors_of_many_levels(spark):
    """100,000 levels: no column a level, and no level comes to the driver."""
    df = spark.range(200_000).selectExpr("id AS request_id", "if(id % 10 = 9, null, concat('v', id % 100000)) AS c", "if(id % 2 = 0, 'x', 'y') AS d", "cast(null AS string) AS e")
    collected = []
    real = type(df).collect

    def spy(self):
        rows = real(self)
        collected.append(len(rows))
        return rows

    type(df).collect = spy
    try:
        out = FT.onehot_vectors(df, ["c", "d", "e"])
    finally:
        type(df).collect = real
    assert out.columns == ["request_id", "c_vec", "d_vec", "e_vec"] and max(collected) < 200
    place = {v: k for k, v in enumerate(sorted({f"v{i}" for i in range(100_000) if i % 10 != 9}))}
    for r in out.where("request_id % 1009 = 0").collect():
        i = r.request_id
        assert r.c_vec.size == 90_000 and r.d_vec.size == 2 and r.e_vec.size == 0
        assert r.c_vec.indices.tolist() == ([] if i % 10 == 9 else [place[f"v{i % 100000}"]])
        assert r.d_vec.toArray().tolist() == ([1.0, 0.0] if i % 2 == 0 else [0.0, 1.0])


def test_onehot_of_named_levels_reads_nothing(spark):
    df = spark.createDataFrame([(1, "b"), (2, "q"), (3, None)], "id BIGINT, c STRING")
    out = FT.onehot(df, levels={"c": ["b", "a"]})
    assert out.columns == ["id", "c_b", "c_a"]
    assert sorted(map(tuple, out.collect())) == [(1, True, False), (2, False, False), (3, False, False)]


def test_fit_partitions_grow_with_the_input():
    few, many = M.fit_partitions(10_000, 16, 8), M.fit_partitions(1_000_000_000, 16, 8)
    assert few == 8 and many == 3815
    assert M.fit_partitions(2_000_000_000, 16, 8) == 2 * many


def test_fit_sample_is_bounded_and_deterministic(spark):
    df = spark.range(50_000).withColumnRenamed("id", "request_id")
    assert M.fit_sample(df, 50_000, 50_000, "request_id", 0) is df
    a = M.fit_sample(df, 50_000, 10_000, "request_id", 0)
    assert 9_000 < a.count() < 11_000
    assert a.exceptAll(M.fit_sample(df.repartition(5), 50_000, 10_000, "request_id", 0)).count() == 0
    frame = spark.range(4000).selectExpr("id AS request_id", "id % 4 AS country", *(f"id % 4 * {k} AS ip_{k}" for k in range(1, 5)))
    run = M._run(frame, M.COUNTRY_FEATURES, "country", 3, 0, "request_id", fit_rows=300, max_depth=4)
    test_side = frame.where(~FT.split_flag()).count()
    assert run.accuracy == 1.0 and run.predictions.count() == test_side     # every test row is scored
    assert "Scan ExistingRDD" in run.predictions._jdf.queryExecution().executedPlan().toString()  # once
