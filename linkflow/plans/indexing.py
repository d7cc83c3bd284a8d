"""Consecutive 0-based numbering of rows in a global order, distributed.

Rows are range partitioned and sorted by their groups and order columns, and
written with ``monotonically_increasing_id()``, which counts on within a task.
So a row's number in its group is its distance from the group's first row in
its task, plus the group's rows in the tasks before. The driver sees one count a
task and group, whatever the number of rows; nothing is sorted in one task,
and there is one plan for all sizes.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# monotonically_increasing_id() has the task in the bits from this one on.
TASK_BITS = 33


def dense_index(df: DataFrame, order_col: str | list[str], index_col: str = "index",
                group_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``index_col`` = position of the row in the order of ``order_col``,
    from 0, counted in each value of ``group_col`` (an integer column without
    nulls, few values) or in the whole table.

    ``order_col`` must be unique (ties would be numbered arbitrarily).
    """
    spark = df.sparkSession
    group = F.col(group_col) if group_col else F.lit(0)
    order = [order_col] if isinstance(order_col, str) else order_col
    keyed = df.withColumn("_group", group.cast("bigint"))
    keys = ["_group", *order]
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    placed = (ranged.sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id())
              .checkpoint())
    task = F.shiftright("_at", TASK_BITS).alias("_task")
    counts = placed.groupBy(task, "_group").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    before: dict[int, int] = defaultdict(int)
    shifts = []
    for row in sorted(counts):
        shifts.append((row["_task"], row["_group"], before[row["_group"]] - row["first"]))
        before[row["_group"]] += row["n"]
    offsets = spark.createDataFrame(shifts, "_task BIGINT, _group BIGINT, _shift BIGINT")
    return (placed.withColumn("_task", task)
            .join(F.broadcast(offsets), ["_task", "_group"])
            .withColumn(index_col, F.col("_at") + F.col("_shift"))
            .drop("_task", "_group", "_at", "_shift"))
