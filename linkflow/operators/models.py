"""Random-forest classifiers over the prepared request features (pyspark.ml).

Two models: IP octets -> country code (50 trees) and every feature but
income -> income code (55 trees). The reference's trees are unbounded, so the
trees here grow to Spark's deepest setting (``max_depth=30``): an octet
triple names a CIDR block, and depth-15 trees cannot tell a thousand blocks
apart (0.67 accuracy at sf 0.1, against 1.00 at depth 30).

Features are cut into at most 64 bins. Spark grows trees level by level and,
per pass, merges one statistics array per node across partitions; its size
is features x bins x classes, so deep trees over many classes pay for bins in
shuffle volume. At sf 0.1, 64 bins scored 1.00 (country) and 0.84 (income)
against 0.99 and 0.85 with 256 bins. Codes are used as plain numbers, so no
categorical arity limit applies.

The fit takes every training row (or, if asked for ``fit_rows``, about that many by
the hash of the id, so the same ones each time). pyspark.ml keeps all nodes in the
driver, so it grows the forest where they surely fit DRIVER_BYTES there (rows
cut into partitions of about FIT_BYTES and at least one a core). Larger ones are grown in
tasks by the same rules (:mod:`linkflow.operators.forest`). Every row of the test
side is scored, once: the predictions are written and the accuracy is read from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.operators import forest as FO
from linkflow.operators.features import split_flag, train_test_split

COUNTRY_FEATURES = ["ip_1", "ip_2", "ip_3", "ip_4"]


@dataclass
class ModelRun:
    model: PipelineModel | FO.Forest
    predictions: DataFrame   # (request_id, label, prediction) on the test side
    accuracy: float


# Bytes of feature values in a partition of the training rows.
FIT_BYTES = 32 << 20
# Bytes of nodes up to which a forest is left to pyspark.ml, which keeps them in the driver.
DRIVER_BYTES = 320 << 20
MAX_DEPTH = 30   # Spark's limit; the reference's trees have none
MAX_BINS = 64


def fit_forest(train: DataFrame, features: list[str], label: str, num_trees: int,
               seed: int = 0, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS,
               max_memory_mb: int = 1024) -> PipelineModel:
    """Fit assembler + forest. ``max_memory_mb`` (statistics per pass) and
    node-id caching only change how many passes deep trees take, not the
    splits chosen."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label,
                                    predictionCol="prediction", numTrees=num_trees,
                                    seed=seed, maxDepth=max_depth, maxBins=max_bins,
                                    maxMemoryInMB=max_memory_mb, cacheNodeIds=True)
    return Pipeline(stages=[assembler, forest]).fit(train)


def accuracy(predictions: DataFrame, label: str = "label") -> float:
    """Share of rows whose prediction equals the label."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                                  metricName="accuracy")
    return float(evaluator.evaluate(predictions))


def fit_partitions(rows: int, features: int, cores: int) -> int:
    """Partitions of the training rows: by their bytes, one a core at least."""
    return max(cores, -(-rows * features * 8 // FIT_BYTES))


def node_bytes(rows: int, num_trees: int, classes: int) -> int:
    """Bytes in the driver of a pyspark.ml forest whose rows all end in leaves of their
    own: two nodes a row, each with counts by class of its own and of both sides."""
    return 2 * rows * num_trees * (256 + 24 * classes)


def fit_sample(train: DataFrame, rows: int, fit_rows: int, id_col: str, seed: int) -> DataFrame:
    """About ``fit_rows`` of ``rows`` training rows by the hash of the id; all
    if there are no more."""
    if rows <= fit_rows:
        return train
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * fit_rows / rows))
    return train.where(part)


def _run(frame: DataFrame, features: list[str], label: str, num_trees: int, seed: int, id_col: str,
         fit_rows: int | None = None, driver_bytes: int = DRIVER_BYTES, max_depth: int = MAX_DEPTH,
         max_bins: int = MAX_BINS, **kw) -> ModelRun:
    # One pass: the class count goes with the label (without it Spark stops at
    # 100 classes), the training rows size the fit.
    seen = frame.agg(F.max(label), F.count_if(split_flag(id_col, seed))).first()
    classes, rows = int(seen[0] or 0) + 1, min(seen[1], fit_rows or seen[1])
    nominal = {"ml_attr": {"type": "nominal", "num_vals": classes, "name": label}}
    data = frame.withColumn(label, F.col(label).cast("double")).withMetadata(label, nominal)
    train, test = train_test_split(data, id_col, seed)
    train = fit_sample(train, seen[1], rows, id_col, seed).select(id_col, label, *features)
    if node_bytes(rows, num_trees, classes) > driver_bytes:
        model = FO.fit(train, features, label, num_trees, classes, rows, seed, max_depth, max_bins)
        scored = model.score(test.withColumn("label", F.col(label)), [id_col, "label"])
        return ModelRun(model, scored, accuracy(scored))
    # Every level of every tree is one pass over the training rows whose
    # per-node statistics are merged across partitions; hashed and sorted by id
    # so that bagging does not depend on input order.
    cores = frame.sparkSession.sparkContext.defaultParallelism
    train = train.repartition(fit_partitions(rows, len(features), cores), id_col).sortWithinPartitions(id_col)
    model = fit_forest(train, features, label, num_trees, seed, max_depth, max_bins, **kw)
    scored = model.transform(test).select(
        id_col, F.col(label).alias("label"), F.col("prediction")).checkpoint()
    return ModelRun(model, scored, accuracy(scored))


def model_country(frame: DataFrame, seed: int = 0, id_col: str = "request_id", **kw) -> ModelRun:
    """50 trees: IP octets -> country code."""
    return _run(frame, COUNTRY_FEATURES, "country", 50, seed, id_col, **kw)


def income_features(frame: DataFrame, id_col: str = "request_id",
                    keep_id: bool = False) -> list[str]:
    """Every column but ``income`` (and, unless ``keep_id``, the row id)."""
    return [c for c in frame.columns if c != "income" and (keep_id or c != id_col)]


def model_income(frame: DataFrame, seed: int = 0, id_col: str = "request_id",
                 keep_id: bool = False, **kw) -> ModelRun:
    """55 trees: all other features -> income code."""
    return _run(frame, income_features(frame, id_col, keep_id), "income", 55, seed, id_col, **kw)
