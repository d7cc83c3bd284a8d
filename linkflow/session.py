"""Session settings and the shared folder for lineage cuts and written tables.

Library code never picks a folder on its own: it reads ``spark.checkpoint.dir``
(or the directory set with ``SparkContext.setCheckpointDir``), which on a
cluster names a shared file system. Only :func:`local_session` (tests, bench,
the driver smoke check) sets one, and only when none is configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes and
# splits skewed shuffle partitions; timestamps are read in UTC.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "linkflow") -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffle count)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LINKFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, partition_bytes: int = 128 * 1024 ** 2,
               min_partitions: int = 200) -> dict[str, str]:
    """Shuffle sizing for an input of ``input_bytes``: about one shuffle
    partition per ``partition_bytes`` of input (AQE then coalesces small ones
    and splits skewed ones), scan splits of the same size."""
    partitions = max(min_partitions, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def apply_session_conf(spark: SparkSession) -> None:
    """Set the SQL settings above on an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; create a local one only if unset
    and the master is local (tests, bench, smoke check). A cluster session
    without a configured folder is an error, never a machine-local fallback.
    """
    current = _configured_dir(spark)
    if current:
        return current
    master = spark.sparkContext.master if _has_context(spark) else ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        # On a cluster a machine-local folder would lose checkpoints with the
        # machine; the shared folder has to be configured.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
    local = tempfile.mkdtemp(prefix="linkflow-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return _configured_dir(spark)


def _has_context(spark: SparkSession) -> bool:
    try:
        spark.sparkContext
    except Exception:  # pragma: no cover - remote sessions
        return False
    return True


def _configured_dir(spark: SparkSession) -> str | None:
    try:
        context = spark.sparkContext
    except Exception:  # pragma: no cover - remote sessions have no context here
        context = None
    from_context = context.getCheckpointDir() if context is not None else None
    if from_context:
        return from_context
    try:
        from_conf = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf lookups differ across modes
        from_conf = None
    if from_conf and context is not None:
        context.setCheckpointDir(from_conf)
        return context.getCheckpointDir()
    return from_conf or None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables; fail if unset."""
    root = _configured_dir(spark)
    if not root:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ...) before running jobs that cut lineage or write tables"
        )
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for one written table or stream."""
    return f"{checkpoint_root(spark).rstrip('/')}/linkflow/{name}-{uuid.uuid4().hex[:12]}"
