"""Operator 7, sharding: vector bin packing of bytes, tokens and rows (law
``bytes``: the shards' sizes are near equal).

Rows of equal text are a group and stay in one shard, except groups over
``split_above`` of a shard's even share in any dimension, which are dealt into
pieces by a hash of the id. Groups above ``alone_above`` of that share are
items of their own; all smaller ones are dealt by hash into BUNDLES bundles a
shard, so the packing sees at most ``shards / alone_above * 3`` items and
``shards * BUNDLES`` bundles however many rows there are. Items go, largest
first, where the dot product of their (bytes, tokens, rows) with the shard's
residual capacity is highest, among the shards that they fit best: a shard
whose residual would fall below zero in any dimension is taken only when none is left.

Bundle totals and item vectors are sums that Spark makes; the packing itself
runs on the driver over that bounded list and its result is broadcast.

Slots: within a shard, rows are numbered gapless from 0 in the order (hash
slice, id, text hash); slices are counted first, so no task orders a shard.

Defined results: a null text has no bytes and no tokens and groups with other
null texts; null ids and repeated rows are dealt like others; an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkflow.llm.common import small, written

ROW_BYTES = 16
BUNDLES = 32
SLICES = 64


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, sizes (items x dimensions)."""
    share = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    vectors, left = sizes / share, np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int32)
    for i in np.lexsort((np.arange(len(sizes)), -vectors.max(axis=1))):
        after = left - vectors[i]
        fits = (after >= -1e-12).all(axis=1)
        score = left @ vectors[i] if fits.any() else after.min(axis=1)
        s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i], left[s] = s, after[s]
    return out


def shard(docs: DataFrame, shards: int = 40, split_above: float = 0.5, alone_above: float = 1 / 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id"),
        F.sha2(F.concat(F.when(F.col(text_col).isNull(), "0").otherwise("1"), text), 256).substr(1, 32).alias("text_key"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).cast("long").alias("text_crc32"),
    ), "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    even = [(x or 0) / shards for x in rows.agg(*sums).first()]
    over = lambda share: F.greatest(*(F.col(c) / max(e * share, 1e-9) for c, e in zip(("size", "tokens", "rows"), even)))

    groups = rows.groupBy("text_key").agg(*sums)
    large = written(groups.where(over(alone_above) > 1).withColumn("pieces", F.when(over(split_above) > 1, F.ceil(over(split_above / 2))).otherwise(1).cast("int")).select("text_key", "pieces"), "shard-groups")
    of_piece = F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces"))
    of_bundle = F.pmod(F.xxhash64("text_key"), F.lit(shards * BUNDLES))
    keyed = rows.join(small(large), "text_key", "left").withColumn("item", F.when(F.col("pieces").isNull(), of_bundle.cast("string")).otherwise(F.concat_ws(":", "text_key", of_piece)))
    items = sorted(map(tuple, keyed.groupBy("item").agg(*sums).collect()))  # bounded: see above
    placed = pack(np.array([x[1:] for x in items], float), shards) if items else []
    places = spark.createDataFrame([(x[0], int(s)) for x, s in zip(items, placed)], "item string, shard int")

    dealt = keyed.join(F.broadcast(places), "item").withColumn("slice", F.pmod(F.xxhash64("id", "text_key"), F.lit(SLICES)).cast("int"))
    counts = dealt.groupBy("shard", "slice").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("shard", "slice").orderBy(F.col("id").asc_nulls_first(), "text_key")
    numbered = dealt.withColumn("place", F.row_number().over(order)).join(F.broadcast(before.drop("count")), ["shard", "slice"])
    slot = (F.col("place") - 1 + F.coalesce("before", F.lit(0))).cast("long")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
