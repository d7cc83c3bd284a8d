"""Listing and deleting folders in whatever store Spark writes to.

Through Hadoop's file systems, so any URI that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolved(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as URI."""
    store, at = _resolved(spark, path)
    return store.makeQualified(at).toUri().toString()


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _resolved(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    store, at = _resolved(spark, path)
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written, if it is there."""
    store, at = _resolved(spark, path)
    store.delete(at, True)
