"""Joins whose large side may have hot keys.

No side is counted or hinted: AQE broadcasts a side whose measured bytes are
under ``spark.sql.autoBroadcastJoinThreshold`` and splits the hot partitions
of a shuffle join. It can split only where the join reads both exchanges
directly, not where one side is an aggregate over its own exchange, so
:func:`split_join` writes that side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def split_join(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``big.join(small, key, how)`` where ``small`` is an aggregate with a row
    per key and any number of keys of ``big`` may be hot."""
    return big.join(small.checkpoint(), key, how)
