"""Sinks: fact tables, ordered JSON reports, log records, idempotent
micro-batch writes. The caller names the path, in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "append",
                partition_by: list[str] | None = None) -> str:
    """Append (or overwrite) ``df`` as a Parquet table at ``path``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_batch(df: DataFrame, path: str, batch_id: int) -> str:
    """Write one micro-batch so that a retried batch replaces its own rows.

    Rows go to partition ``batch_id=<id>``; with dynamic partition overwrite a
    replay rewrites that partition only, so no row is written twice.
    """
    (df.withColumn("batch_id", F.lit(int(batch_id)))
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id")
       .parquet(path))
    return path


def write_report(df: DataFrame, path: str, order: list[str], rows_per_file: int = 100_000) -> str:
    """``df`` as JSON lines in the order of ``order``: files in name order, rows
    in file order, whatever the size. Sorted by ranges, so no task holds the
    report; ``rows_per_file`` cuts its files, and a short report is one file."""
    ordered = df.orderBy(*order)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


LOG_SCHEMA = "request_id BIGINT, severity STRING, status INT, message STRING, batch_id BIGINT"


def write_log_records(records: DataFrame, path: str) -> str:
    """Append log records ``(request_id, severity, status, message)`` as JSON
    lines, one folder per severity, for a log collector to pick up."""
    records.write.mode("append").partitionBy("severity").json(path)
    return path


def write_log_batch(records: DataFrame, path: str, batch_id: int) -> str:
    """One micro-batch's log records as JSON lines, a folder for each batch and
    severity: ``batch_id=<id>/severity=<name>``. The batch's folder is replaced as
    a whole, so a replay leaves no row twice, also of a severity that the replay
    no longer has."""
    (records.write.mode("overwrite").partitionBy("severity").json(f"{path}/batch_id={int(batch_id)}"))
    return path


def read_log_records(spark: SparkSession, path: str, severity: str | None = None) -> DataFrame:
    """The written log records; of one severity, only its folders are listed."""
    records = spark.read.schema(LOG_SCHEMA).option("basePath", path).json(path)
    return records if severity is None else records.where(F.col("severity") == severity)
