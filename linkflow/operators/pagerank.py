"""Iterative PageRank as a driver loop over DataFrames.

One round::

    raw(p) = 0.15 + 0.85 * sum over edges s->p of rank(s) / outdeg(s)
    rank'(p) = raw(p) / sum(raw)

No 1/N factor; the mass of pages without out-links is not redistributed.
Nodes are the crawled pages plus every link target; crawled pages start at
``initial``, the others at 0. Multi-edges and self-links count each time.

Stop rules:

* ``stop="sum"``: stop when ``|sum(rank') - sum(rank)| < threshold``. Ranks sum
  to 1 after every round, so this ends after round 2 unless the start sum is
  already within the threshold of 1 (then after round 1).
* ``stop="l1"``: stop when ``sum |rank' - rank| < threshold`` or after
  ``max_iter`` rounds; a real convergence test.

Plan at scale:

* Edges are reduced once to ``(src, dst, links)``, then joined to the degrees of
  their sources while AQE is on: it splits a hub source's partition. A source with
  many distinct targets is split into ``ceil(targets / split_rows)`` salted
  slices: edges get ``salt = md5(dst) mod slices`` and the rank of that source is
  replicated once per slice, so a hub source is spread over many tasks.
* The weighted edges are written, then checkpointed hash-partitioned and sorted by
  ``(src, salt)``, and the rounds run without AQE (a checkpoint taken under AQE
  forgets its partitioning): per round only the rank side (one row per node
  and slice) moves to them. Contributions are summed per target with a map-side
  partial aggregate, so hub targets are reduced before the shuffle.
* A round writes ``rounds/<n>`` (page, slices, raw, prev) as Parquet and then, as
  the mark that it is complete, one row in ``history/<n>`` (round, total,
  difference). Both totals are scalars brought to the driver.

A run with a ``folder`` of its own can be resumed: called again with it after a lost
driver, it reads the written edges and goes on from the newest complete round.
Rounds n - 2 and older are deleted once round n is complete. Without a folder a
fresh one in the shared storage is used, whose edges are deleted at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkflow.plans.joins import split_join
from linkflow.session import scratch_path
from linkflow.sources import storage

DAMPING = 0.85
BASE = 0.15
# Distinct targets per salted slice of one source.
SPLIT_ROWS = 100_000
STATE = "page STRING, slices BIGINT, raw DOUBLE, prev DOUBLE"
HISTORY = "round INT, total DOUBLE, difference DOUBLE"
EDGES = "src STRING, salt BIGINT, dst STRING, share DOUBLE"


@dataclass
class PageRankResult:
    ranks: DataFrame          # (page, rank)
    rounds: int
    last_difference: float
    converged: bool           # False: ``max_iter`` ended the run
    history: DataFrame        # (round, total, difference) of every round


def _slice_of(dst, slices):
    """The slice of an edge; only the edges of sources with several are hashed."""
    head = F.conv(F.substring(F.md5(dst), 1, 8), 16, 10).cast("bigint")
    return F.when(slices > 1, F.pmod(head, slices)).otherwise(F.lit(0).cast("bigint"))


def weighted_edges(pairs: DataFrame, per_src: DataFrame) -> DataFrame:
    """``(src, salt, dst, share)``: a hub source's pairs must not meet its
    degree row in one task, so this join is planned under AQE."""
    return (split_join(pairs, per_src, "src", "inner")
            .select("src", _slice_of(F.col("dst"), F.col("slices")).alias("salt"), "dst",
                    (F.col("links") / F.col("outdeg")).alias("share")))


def laid_out(weighted: DataFrame, partitions: int) -> DataFrame:
    """The weighted edges hash-partitioned and sorted by ``(src, salt)``: the
    edges of a hub source are spread over its slices, hence over many partitions,
    and each round's merge join reads them as they lie (no shuffle, no sort)."""
    return (weighted.repartition(partitions, "src", "salt")
            .sortWithinPartitions("src", "salt")
            .checkpoint())


def source_degrees(pairs: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(src, outdeg, slices)`` from ``(src, dst, links)``."""
    return pairs.groupBy("src").agg(
        F.sum("links").alias("outdeg"),
        F.ceil(F.count(F.lit(1)) / F.lit(split_rows)).cast("bigint").alias("slices"))


def _prepare(edges: DataFrame, crawled: DataFrame | None, initial: float, split_rows: int, folder: str) -> None:
    """Writes ``folder``/edges and round 0, whose history row comes last."""
    # The edge input (often a link extraction over the whole corpus) is read
    # once: everything below derives from the written (src, dst, links) table.
    pairs = (edges.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"))
             .agg(F.count(F.lit(1)).alias("links")))
    pairs.write.mode("overwrite").parquet(f"{folder}/pairs")
    pairs = edges.sparkSession.read.schema(pairs.schema).parquet(f"{folder}/pairs")
    per_src = source_degrees(pairs, split_rows)
    weighted_edges(pairs, per_src).write.mode("overwrite").parquet(f"{folder}/edges")
    # Every crawled page and every endpoint once, with its slice count: one aggregate.
    none = F.lit(None).cast("bigint")
    rows = (per_src.select(F.col("src").alias("page"), "slices", F.lit(crawled is None).alias("starts"))
            .unionByName(pairs.select(F.col("dst").alias("page"), none.alias("slices"), F.lit(False).alias("starts"))))
    if crawled is not None:
        rows = rows.unionByName(crawled.select("page", none.alias("slices"), F.lit(True).alias("starts")))
    nodes = rows.groupBy("page").agg(
        F.coalesce(F.max("slices"), F.lit(0)).alias("slices"),
        F.when(F.max("starts"), F.lit(initial)).otherwise(F.lit(0.0)).alias("raw"), F.lit(0.0).alias("prev"))
    nodes.write.mode("overwrite").parquet(f"{folder}/rounds/0")
    storage.delete(edges.sparkSession, f"{folder}/pairs")
    _finish(edges.sparkSession, folder, 0, 1.0, float("inf"))


def _finish(spark: SparkSession, folder: str, n: int, total: float, difference: float) -> None:
    """Marks round ``n`` complete and deletes rounds ``n - 2`` and older."""
    row = spark.createDataFrame([(n, float(total), float(difference))], HISTORY)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/history/{n}")
    for name in storage.children(spark, f"{folder}/rounds"):
        if int(name) <= n - 2:
            storage.delete(spark, f"{folder}/rounds/{name}")


def complete_rounds(spark: SparkSession, folder: str) -> list[int]:
    """The rounds of a run whose history row was committed, ascending."""
    names = storage.children(spark, f"{folder}/history")
    return sorted(int(n) for n in names if storage.exists(spark, f"{folder}/history/{n}/_SUCCESS"))


def _history(spark: SparkSession, folder: str, rounds: list[int]) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(*(f"{folder}/history/{n}" for n in rounds))


def _state(spark: SparkSession, folder: str, n: int, total: float) -> DataFrame:
    """(page, slices, rank) after round ``n``."""
    state = spark.read.schema(STATE).parquet(f"{folder}/rounds/{n}")
    rank = F.col("raw") / F.lit(total) if total else F.lit(0.0)
    return state.select("page", "slices", rank.alias("rank"), "prev")


def pagerank_run(edges: DataFrame, crawled: DataFrame | None = None, *,
                 threshold: float = 0.005, stop: str = "sum", max_iter: int = 100,
                 initial: float = 0.01, split_rows: int = SPLIT_ROWS,
                 partitions: int | None = None, folder: str | None = None) -> PageRankResult:
    """Run PageRank over ``edges(source, target)``.

    ``crawled`` (column ``page``) is the set of pages that start at
    ``initial``; by default every page with out-links. ``folder``: where the
    rounds are kept, in shared storage; a run found there is resumed (its edges
    and start ranks are those that it was begun with).
    """
    if stop not in ("sum", "l1"):
        raise ValueError("stop must be 'sum' or 'l1'")
    spark = edges.sparkSession
    own = folder is None
    folder = (folder or scratch_path(spark, "pagerank")).rstrip("/")
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not complete_rounds(spark, folder):
        _prepare(edges, crawled, initial, split_rows, folder)

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        result = _rounds(spark, folder, threshold, stop, max_iter, n_part)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    if own:
        storage.delete(spark, f"{folder}/edges")
    return result


def round_inflow(weighted: DataFrame, state: DataFrame) -> DataFrame:
    """``(page, inflow)`` of one round from the ranks of the last."""
    sent = (state.where((F.col("slices") > 0) & (F.col("rank") != 0))
            .select(F.col("page").alias("src"), "rank",
                    F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("salt")))
    return (weighted.join(sent, ["src", "salt"])
            .groupBy(F.col("dst").alias("page"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("inflow")))


def _rounds(spark: SparkSession, folder: str, threshold: float, stop: str, max_iter: int, n_part: int) -> PageRankResult:
    n = complete_rounds(spark, folder)[-1]
    last = _history(spark, folder, [n]).first()
    total, diff = last["total"], last["difference"]
    weighted = None
    while not _stops(n, diff, threshold, stop, max_iter):
        if weighted is None:
            weighted = laid_out(spark.read.schema(EDGES).parquet(f"{folder}/edges"), n_part)
        state = _state(spark, folder, n, total)
        inflow = round_inflow(weighted, state)
        raw = F.lit(BASE) + F.lit(DAMPING) * F.coalesce("inflow", F.lit(0.0))
        new = state.select("page", "slices", F.col("rank").alias("prev")).join(inflow, "page", "left").select("page", "slices", raw.alias("raw"), "prev")
        n += 1
        new.write.mode("overwrite").parquet(f"{folder}/rounds/{n}")
        written = spark.read.schema(STATE).parquet(f"{folder}/rounds/{n}")
        sums = written.agg(F.sum("raw"), F.sum("prev")).first()
        total = sums[0] or 0.0
        if not total:
            diff = 0.0
        elif stop == "sum":
            diff = 1.0 - sums[1]  # ranks sum to 1 after every round
        else:
            diff = _state(spark, folder, n, total).agg(F.sum(F.abs(F.col("rank") - F.col("prev")))).first()[0]
        _finish(spark, folder, n, total, diff)
    rounds = [k for k in complete_rounds(spark, folder) if k]
    history = _history(spark, folder, rounds) if rounds else spark.createDataFrame([], HISTORY)
    ranks = _state(spark, folder, n, total).select("page", "rank")
    return PageRankResult(ranks, n, float(diff), abs(diff) < threshold or not total, history)


def _stops(n: int, diff: float, threshold: float, stop: str, max_iter: int) -> bool:
    """Whether a run ends after round ``n`` (an empty graph's first round has no difference)."""
    return n > 0 and (abs(diff) < threshold or diff == 0.0 or stop == "l1" and n >= max_iter)


def pagerank(edges: DataFrame, crawled: DataFrame | None = None, **kwargs) -> DataFrame:
    """Ranks ``(page, rank)``; see :func:`pagerank_run` for the options."""
    return pagerank_run(edges, crawled, **kwargs).ranks
