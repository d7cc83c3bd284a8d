"""Feature and model queries over the ``requests`` fact rows."""

from __future__ import annotations


from pyspark.sql import functions as F

from linkflow.operators import features as FT
from linkflow.operators import models as M
from linkflow.plans.catalog import register
from linkflow.plans.q_requests import FACT_REQUESTS_BODY, dec_sql, fact_requests
from linkflow.sources import tables as T

# Value domains of the one-hot columns in the request view (for the oracle).
_GENDERS = ["Female", "Male"]
_AGES = ["0-16", "17-25", "26-35", "36-45", "46-55", "56-65", "66-75", "76+"]


def _code_cte(col: str) -> tuple[str, str]:
    return (f"code_{col}", f"""SELECT {col} AS v,
       CAST(row_number() OVER (ORDER BY min(request_id)) - 1 AS BIGINT) AS code
FROM req GROUP BY {col}""")


def _req_sql(body: str, extra: list[tuple[str, str]] = ()) -> str:
    ctes = [("dec", dec_sql(True)), ("req", FACT_REQUESTS_BODY)]
    ctes += [_code_cte(c) for c in FT.CODED_COLUMNS] + list(extra)
    return T.with_views(body, "requests_raw", "files", ctes=ctes)


_CODE_JOINS = "\n".join(
    f"JOIN code_{c} ON r.{c} IS NOT DISTINCT FROM code_{c}.v" for c in FT.CODED_COLUMNS)
_CODES = ", ".join(f"code_{c}.code AS {c}" for c in FT.CODED_COLUMNS)
_OCTETS = ", ".join(
    f"CAST(split_part(r.ip_address, '.', {i}) AS INTEGER) AS ip_{i}" for i in range(1, 5))
_ONEHOT = ", ".join(
    [f"coalesce(r.gender = '{v}', false) AS \"gender_{v}\"" for v in _GENDERS]
    + [f"coalesce(r.age = '{v}', false) AS \"age_{v}\"" for v in _AGES])


def _facts(spark, sf_dir, *columns):
    """The requests table's ``columns``; a plan of its own for each step, so
    that only the source columns behind them are read."""
    return fact_requests(spark, sf_dir).select(*columns)


@register("ip_octets", _req_sql(f"SELECT r.request_id, {_OCTETS} FROM req r"))
def ip_octets(spark, sf_dir):
    return FT.ip_octets(_facts(spark, sf_dir, "request_id", "ip_address"))


@register("factorize", _req_sql(f"SELECT r.request_id, {_CODES} FROM req r {_CODE_JOINS}"))
def factorize(spark, sf_dir):
    cols = ["request_id", *FT.CODED_COLUMNS]
    return FT.factorize(_facts(spark, sf_dir, *cols).checkpoint())


@register("onehot_features", _req_sql(f"SELECT r.request_id, {_ONEHOT} FROM req r"))
def onehot_features(spark, sf_dir):
    return FT.onehot(_facts(spark, sf_dir, "request_id", "gender", "age"), levels={"gender": _GENDERS, "age": _AGES})


@register("onehot_wide", _req_sql("""SELECT r.request_id, f.n AS size, f.k AS place FROM req r JOIN (
  SELECT file_name, CAST(row_number() OVER (ORDER BY file_name) - 1 AS INTEGER) AS k, CAST(count(*) OVER () AS INTEGER) AS n
  FROM (SELECT DISTINCT file_name FROM req)) f ON r.file_name = f.file_name"""))
def onehot_wide(spark, sf_dir):
    """File names, a domain that grows with the requests, as sparse vectors:
    their size and the place of the one."""
    vectors = FT.onehot_vectors(_facts(spark, sf_dir, "request_id", "file_name").checkpoint(), ["file_name"])
    ones = F.get_json_object(F.to_json(F.struct(F.col("file_name_vec").alias("v"))), "$.v")
    return vectors.select("request_id", F.get_json_object(ones, "$.size").cast("int").alias("size"),
                          F.get_json_object(ones, "$.indices[0]").cast("int").alias("place"))


MODEL_FEATURES_SQL = _req_sql(
    f"SELECT r.request_id, {_CODES}, r.is_banned, {_OCTETS}, {_ONEHOT} FROM req r {_CODE_JOINS}")


@register("model_features", MODEL_FEATURES_SQL)
def model_features(spark, sf_dir):
    return FT.prepare_features(_facts(spark, sf_dir, "*").checkpoint())


@register("train_test_split", _req_sql(
    "SELECT request_id, substr(md5(CAST(request_id AS VARCHAR) || ':0'), 1, 8) < 'b3333333' "
    "AS is_train FROM req"))
def train_test_split(spark, sf_dir):
    return _facts(spark, sf_dir, "request_id", FT.split_flag("request_id", 0).alias("is_train"))


# Model queries: test-side predictions with the run's accuracy (rows-only check).

@register("model_country")
def model_country(spark, sf_dir):
    frame = model_features(spark, sf_dir).checkpoint()
    run = M.model_country(frame)
    return run.predictions.withColumn("accuracy", F.lit(run.accuracy))


@register("model_income")
def model_income(spark, sf_dir):
    frame = model_features(spark, sf_dir).checkpoint()
    run = M.model_income(frame)
    return run.predictions.withColumn("accuracy", F.lit(run.accuracy))


@register("rule_accuracy", _req_sql(
    "SELECT round(avg(CASE WHEN is_banned = (gender = 'Male') THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM req"))
def rule_accuracy(spark, sf_dir):
    """The models' accuracy measure on a rule that SQL has too."""
    rows = _facts(spark, sf_dir, F.col("is_banned").cast("double").alias("label"),
                  (F.col("gender") == "Male").cast("double").alias("prediction"))
    return spark.createDataFrame([(round(M.accuracy(rows), 9),)], "accuracy double")
