"""Small helpers shared by the operators: tables, Arrow slices, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkflow.session import ensure_checkpoint_dir, scratch_path

#: Rows that one step of a Python worker holds besides the Arrow batch it reads.
SLICE_ROWS = 256
#: Rows of an Arrow batch between Spark and a Python worker.
BATCH_ROWS = 1024
#: A side is broadcast only when its counted rows times this row size stay below.
BROADCAST_BYTES = 32 << 20
#: A bounded memo (word -> result) in a worker starts anew beyond this many entries.
MEMO_ENTRIES = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: dict[tuple, object] = {}


def hold(*key, make: Callable | None = None):
    """make(), kept by this worker process while it is asked for by the same
    key: workers outlive a stage, and a vocabulary with its memos should not
    outlive the stages that use it. hold() drops what is kept."""
    if key not in _held:
        _held.clear()
        if key:
            _held[key] = make()
    return _held.get(key)


def mapped(df: DataFrame, run: Callable, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``rows`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder under spark.checkpoint.dir and read
    back: lineage is cut in storage that outlives executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 64, more: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast when its counted rows fit BROADCAST_BYTES;
    otherwise as it is, and Spark shuffles the join (AQE splits hot keys).
    ``more``: the bytes of a row beyond ``row_bytes``, where rows differ."""
    total = df.count() * row_bytes if more is None else df.agg(F.sum(F.lit(row_bytes).cast("long") + more)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


class Memo(dict):
    """word -> make(word), for words up to ``longest``; starts anew when full."""

    def __init__(self, make: Callable, longest: int = 64, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.longest, self.entries = make, longest, entries

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[word] = value
        return value
