"""Random forests of any size: trees are grown in tasks, none is held by the driver.

pyspark.ml keeps every node of every tree in the driver and sends the whole
forest to each executor. Trees that grow until their leaves are pure have
nodes in proportion to rows x trees, so that ends at some thousand rows.

Here the training rows are written once as blocks of bin numbers. A tree's bag
(Poisson(1) weights) follows from seed, tree and block, a node's features from
seed, tree and node, so any task can work them out. Growing has two parts:

1. :func:`fit`: a node with more than LOCAL_ROWS rows in the bag is split from counts by
   (class, bin) that tasks add up; the driver sees the best cut of each. These
   nodes are the top of the tree, about rows / LOCAL_ROWS of them.
2. :meth:`Forest.score`: below, the rows of a node, those to train and those to score,
   go to one task, which grows the rest of the tree from the former and drops it
   when the latter have their leaf. Votes are added up by row.

Rules as in pyspark.ml: Gini gain, ceil(sqrt(features)) features a node, cuts at
quantiles, leaves where a node is pure, at ``max_depth`` or where no drawn feature
gains; a tree votes with the class shares of the leaf; the first of equal classes wins.
Leaves whose parent would say the same stay apart, as in the reference.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows in the bag up to which the rest of a tree is grown in one task.
LOCAL_ROWS = 1 << 18
# Rows of a block, and values at most of the table of votes for a block of rows to score.
BLOCK_ROWS, BLOCK_VOTES = 1 << 16, 1 << 21
# Blocks in an Arrow batch between Spark and a worker.
BATCH_BLOCKS = 16
# Counts by (class, bin) that a task collects before it adds up equal ones.
MERGE_ROWS = 1 << 21
# Least gain, relative to the score of the unsplit node (rounding is below).
LEAST_GAIN = 1e-12
_PIECE = "_tree int, _node int, _part bigint, _score boolean, _block bigint, x binary, y binary, w binary"
_VOTE = "_block bigint, _tree int, _node int, row binary, class binary, share binary"


# --- numpy: one tree or a part of it -----------------------------------------

def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def counted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the weights of each."""
    if not len(key):
        return key, weight
    if weight.max() < 256:   # both in one number: no index to sort
        packed = np.sort(key << 8 | weight)
        key, weight = packed >> 8, packed & 255
    else:
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
    at = _starts(key)
    return key[at], np.add.reduceat(weight, at)


def best_cuts(key: np.ndarray, weight: np.ndarray, classes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For the slots 0, 1, ... the gain of the best cut of one feature and the last bin
    on its left; -1 for no gain. ``key``: distinct and ordered (slot * classes + class) * bins + bin.

    A cut's score is the sum over its sides of sum(class count squared) / count. With the bins
    in order, a class count c that becomes c + q changes its square by q (2 c + q).
    """
    group = key // bins
    at = _starts(group)
    totals, sizes = np.add.reduceat(weight, at), np.diff(np.append(at, len(key)))
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[at], sizes)                    # of the class, in lower bins
    left = weight * (2 * before + weight)
    right = weight * (weight - 2 * (np.repeat(totals, sizes) - before))
    of_slot = group[at] // classes
    size, square = np.bincount(of_slot, totals), np.bincount(of_slot, totals.astype(float) ** 2)

    cell = group // classes * bins + key % bins               # slot, bin
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    at = _starts(cell)
    slot, n, left, right = cell[at] // bins, *(np.add.reduceat(v[order], at) for v in (weight, left, right))
    first = _starts(slot)
    sizes = np.diff(np.append(first, len(slot)))

    def running(v):
        total = np.cumsum(v)
        return total - np.repeat((total - v)[first], sizes)

    n, left, right = running(n), running(left), running(right) + square[slot]
    rest = size[slot] - n
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(rest > 0, left / n + right / rest, -1.0)
    best = np.maximum.reduceat(score, first)
    hits = np.flatnonzero(score == np.repeat(best, sizes))
    hits = hits[_starts(slot[hits])]                          # the first of equal ones
    whole = square / size
    return np.where(best > whole * (1 + LEAST_GAIN), best - whole, -1.0), cell[at][hits] % bins


def drawn(seed: int, tree: int, nodes: np.ndarray, features: int, take: int) -> np.ndarray:
    """``take`` of the feature numbers for each node: those with the least hashes."""
    with np.errstate(over="ignore"):
        h = (nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
             + np.uint64(hash((seed, tree)) & (1 << 63) - 1) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(h ^ (h >> np.uint64(31)), axis=1, kind="stable")[:, :take]


@dataclass
class Rules:
    """What a tree is grown by."""
    features: int
    classes: int
    bins: int
    max_depth: int
    seed: int

    @property
    def take(self) -> int:
        return ceil(sqrt(self.features))

    def bag(self, tree: int, block: int, rows: int) -> np.ndarray:
        return np.random.default_rng([self.seed & (1 << 63) - 1, tree, block]).poisson(1.0, rows)


@dataclass
class Tree:
    """Nodes as columns: feature (-1: a leaf), last bin on the left, left child (the right one
    follows), number as in a heap. Votes of leaf k: class and share at ``first[k]``
    up to ``first[k + 1]``."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    heap: np.ndarray
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node where each column of ``x`` ends."""
        node, on = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while True:
            at = node[on]
            on = on[self.feature[at] >= 0]
            if not len(on):
                return node
            at = node[on]
            node[on] = self.left[at] + (x[self.feature[at], on] > self.cut[at])

    def votes(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, class, share)`` of each vote for rows that end in ``leaf``."""
        n = self.first[leaf + 1] - self.first[leaf]
        row = np.repeat(np.arange(len(leaf)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - self.first[leaf], n)
        return row, self.classes[at], self.shares[at]


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, heap: int, rules: Rules) -> Tree:
    """The part of a tree below node ``heap``, from the node's rows: bins ``x`` (a row a feature),
    classes ``y``, weights ``w`` of one or more. Level by level, all nodes of a level at once."""
    k, bins = rules.classes, rules.bins
    rows, slot, heaps, begin = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([heap]), 0
    levels, ends = [], []
    while True:
        m = len(heaps)
        key, q = counted(slot * k + y[rows], w[rows])
        of = key // k
        size = np.bincount(of, q, m)
        feature, cut = np.full(m, -1), np.zeros(m, np.int64)
        mixed = np.bincount(of, minlength=m) > 1
        if heap_depth(heaps[0]) < rules.max_depth and mixed.any():
            here = mixed[slot]
            r, s = rows[here], (np.cumsum(mixed) - 1)[slot[here]]
            feature[mixed], cut[mixed] = _chosen(x, r, s, s * k + y[r], w[r], tree, heaps[mixed], rules)
        split = feature >= 0
        ended = ~split[of]
        ends.append((begin + of[ended], key[ended] % k, q[ended] / size[of[ended]]))
        left = np.zeros(m, np.int64)
        left[split] = begin + m + 2 * np.arange(split.sum())
        levels.append((feature, cut, left, heaps))
        if not split.any():
            break
        here = split[slot]
        rows, slot = rows[here], slot[here]
        slot = 2 * (np.cumsum(split) - 1)[slot] + (x[feature[slot], rows] > cut[slot])
        heaps, begin = np.add.outer(2 * heaps[split], [0, 1]).ravel(), begin + m
    node, classes, shares = (np.concatenate(v) for v in zip(*ends))
    columns = [np.concatenate(v) for v in zip(*levels)]
    return Tree(*columns, np.searchsorted(node, np.arange(len(columns[0]) + 1)), classes, shares)


def _chosen(x, rows, slot, mix, w, tree, heaps, rules):
    """The best of the drawn features of each slot and its cut; -1 where none gains."""
    options = drawn(rules.seed, tree, heaps, rules.features, rules.take)
    feature, cut, best = np.full(len(heaps), -1), np.zeros(len(heaps), np.int64), np.zeros(len(heaps))
    for option in options.T:
        gain, at = best_cuts(*counted(mix * rules.bins + x[option[slot], rows], w), rules.classes, rules.bins)
        better = gain > best
        feature[better], cut[better], best[better] = option[better], at[better], gain[better]
    return feature, cut


def heap_depth(heap: int) -> int:
    """0 for the root, whose number is 1."""
    return int(heap).bit_length() - 1


# --- blocks of rows -----------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    """Bytes of an array with its type and shape, compressed."""
    values = np.ascontiguousarray(values)
    raw = values.tobytes()
    return pickle.dumps((values.dtype.str, values.shape, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))


def _unpacked(data: bytes) -> np.ndarray:
    kind, shape, size, raw = pickle.loads(data)
    return np.frombuffer(pa.decompress(raw, size, codec="zstd"), kind).reshape(shape)


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows in tables of ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _streamed(df: DataFrame, key: list[str], order: list[str], run: Callable, schema, partitions: int) -> DataFrame:
    """``run`` over the rows in ``order`` within each ``key``, a stream to a task: no group is held as such."""
    dealt = df.repartition(partitions, *key).sortWithinPartitions(*key, *order)
    return dealt.mapInArrow(run, schema)


@contextmanager
def _few_blocks(spark: SparkSession):
    """Arrow batches of BATCH_BLOCKS rows for what runs inside: rows are blocks here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature at most ``bins`` - 1 thresholds between its quantiles,
    the least and the largest value among them."""
    at = F.array(*[F.lit(i / (bins - 1)) for i in range(bins)])
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, F.lit(10_000)) for f in features]).first()
    values = [np.unique(np.array(v or [], float)) for v in found]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def _blocks(df: DataFrame, features: list[str], label: str | None, keep: list[str], cuts: list[np.ndarray],
            rows: int) -> DataFrame:
    """``(_block, x, y, kept)``: the bins, the classes of ``label``, the columns ``keep`` of ``rows`` rows a block."""
    names = [f"_f{i}" for i in range(len(features))]
    schema = "_block bigint, x binary, y binary, kept binary"
    out, kind = _arrow(schema), np.uint8 if max(map(len, cuts)) < 256 else np.uint16

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, table in enumerate(_held(batches, rows)):
            x = np.empty((len(names), table.num_rows), kind)
            for i, name in enumerate(names):
                values = table[name].to_numpy()
                if np.isnan(values).any():
                    raise ValueError(f"feature {features[i]} has null or NaN")
                x[i] = np.searchsorted(cuts[i], values)
            y, kept = None, None
            if label:
                if table["_y"].null_count:
                    raise ValueError(f"label {label} has null")
                y = _packed(table["_y"].to_numpy().astype(np.int32))
            else:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (part := table.select(keep)).schema) as to:
                    to.write_table(part)
                kept = sink.getvalue().to_pybytes()
            yield _batch(out, [(task << 32 | k, _packed(x), y, kept)])

    columns = [F.col(f).cast("double").alias(n) for f, n in zip(features, names)]
    own = [F.col(label).cast("int").alias("_y")] if label else []
    return df.select(*columns, *own, *keep).mapInArrow(run, schema)


# --- the forest -----------------------------------------------------------------

@dataclass
class Forest:
    """A forest: the tops of its trees and the blocks of training rows from which the rest is grown."""
    features: list[str]
    rules: Rules
    cuts: list[np.ndarray]
    blocks: DataFrame
    tops: list[Tree]

    @property
    def numClasses(self) -> int:
        return self.rules.classes

    def score(self, df: DataFrame, keep: list[str], prediction: str = "prediction") -> DataFrame:
        """Columns ``keep`` of each row of ``df`` with its predicted class; written."""
        spark, rules, tops = df.sparkSession, self.rules, self.tops
        rows = max(1, min(BLOCK_ROWS // 2, BLOCK_VOTES // rules.classes))
        asked = _blocks(df, self.features, None, keep, self.cuts, rows).checkpoint()
        schema = StructType(df.select(*keep).schema.fields).add(prediction, "double")
        columns = [*keep, prediction]
        parts = max(spark.sparkContext.defaultParallelism, sum(int((t.feature < 0).sum()) for t in tops))
        blocks = max(1, asked.count())
        with _few_blocks(spark):
            pieces = (self.blocks.select("_block", "x", "y").unionByName(asked.select("_block", "x", "y"))
                      .mapInArrow(lambda batches: _dealt(batches, tops, rules), _PIECE))
            votes = _streamed(pieces, ["_tree", "_node", "_part"], ["_score", "_block"],
                              lambda batches: _voted(batches, tops, rules), _VOTE, min(parts, 10_000))
            none = F.lit(None).cast("binary")
            rows_of = asked.select("_block", F.lit(-1).alias("_tree"), F.lit(0).alias("_node"), none.alias("row"), none.alias("class"), F.col("kept").alias("share"))
            return _streamed(rows_of.unionByName(votes), ["_block"], ["_tree", "_node"],
                             lambda batches: _elected(batches, rules.classes, columns), schema, min(blocks, 10_000)).checkpoint()


def _dealt(batches, tops, rules):
    """Each block's rows by tree and node below its top: those in the bag to train, all to score.
    ``_part`` spreads the rows of a leaf that the top has: they need no others."""
    out = _arrow(_PIECE)
    for block, x, y in _rows(batches):
        x, y = _unpacked(x), None if y is None else _unpacked(y)
        for tree, top in enumerate(tops):
            node = top.leaves(x)
            if y is not None:
                w = rules.bag(tree, block, len(y))
                w[top.first[node + 1] > top.first[node]] = 0      # the leaf is known: no row is needed
                rows = np.flatnonzero(w)
            else:
                rows = np.arange(len(node))
            rows = rows[np.argsort(node[rows], kind="stable")]
            if not len(rows):
                continue
            pieces = []
            for part in np.split(rows, _starts(node[rows])[1:]):
                own = (_packed(y[part]), _packed(w[part].astype(np.uint8))) if y is not None else (None, _packed(part.astype(np.int32)))
                at = int(node[part[0]])
                known = top.first[at + 1] > top.first[at]
                pieces.append((tree, at, block if known else -1, y is None, block, _packed(x[:, part]), *own))
            yield _batch(out, pieces)


def _voted(batches, tops, rules):
    """Votes for the rows to score of each (tree, node), which come after those to train."""
    out = _arrow(_VOTE)
    key, train, part = None, [], None
    for tree, node, _, score, block, x, y, w in _rows(batches):
        if (tree, node) != key:
            key, train, part = (tree, node), [], None
        if not score:
            train.append((_unpacked(x), _unpacked(y), _unpacked(w)))
            continue
        top = tops[tree]
        if part is None and top.first[node + 1] == top.first[node]:
            if train:
                x0, y0, w0 = (np.concatenate(v, axis=-1) for v in zip(*train))
                part = grown(x0, y0.astype(np.int64), w0.astype(np.int64), tree, int(top.heap[node]), rules)
                train = []
            else:   # an empty bag: the first class, as a tree without rows has it
                part = Tree(*(np.array([v]) for v in (-1, 0, 0, 1)), np.array([0, 1]), np.array([0]), np.array([1.0]))
        x = _unpacked(x)
        if part is None:
            row, classes, shares = top.votes(np.full(x.shape[1], node))
        else:
            row, classes, shares = part.votes(part.leaves(x))
        rows = _unpacked(w)[row]
        yield _batch(out, [(block, tree, node, _packed(rows), _packed(classes.astype(np.int32)), _packed(shares))])


def _elected(batches, classes, columns):
    """The kept columns of each block with the class of most votes."""
    rows = votes = None

    def ended():
        chosen = pa.array(votes.argmax(axis=1).astype(float))
        return pa.Table.from_arrays([*rows.columns, chosen], names=columns).to_batches()

    for _, tree, _, row, name, share in _rows(batches):
        if tree < 0:
            if rows is not None:
                yield from ended()
            rows = pa.ipc.open_stream(share).read_all()
            votes = np.zeros((rows.num_rows, classes))
        else:
            votes[_unpacked(row), _unpacked(name)] += _unpacked(share)
    if rows is not None:
        yield from ended()


def fit(train: DataFrame, features: list[str], label: str, num_trees: int, classes: int, rows: int,
        seed: int = 0, max_depth: int = 30, max_bins: int = 64, local_rows: int = LOCAL_ROWS) -> Forest:
    """The forest of ``train``, which has ``rows`` rows."""
    cuts = quantile_cuts(train, features, max_bins)
    rules = Rules(len(features), classes, max_bins, max_depth, seed)
    # Dealt and sorted by all columns: bags depend on neither the input's order nor
    # the cores, and ids that repeat or are null don't gather in one task.
    dealt = train.repartition(max(1, 2 * rows // BLOCK_ROWS), *train.columns).sortWithinPartitions(*train.columns)
    blocks = _blocks(dealt, features, label, [], cuts, BLOCK_ROWS).checkpoint()
    tops = [Tree(np.array([-1]), np.array([0]), np.array([0]), np.array([1]), np.zeros(2, np.int64)) for _ in range(num_trees)]
    wide = {t: [0] for t in range(num_trees)} if rows > local_rows and max_depth > 0 else {}
    with _few_blocks(train.sparkSession):
        while wide:
            wide = _deeper(blocks, tops, wide, rules, local_rows)
    return Forest(features, rules, cuts, blocks, tops)


def _deeper(blocks: DataFrame, tops: list[Tree], wide: dict[int, list[int]], rules: Rules, local_rows: int) -> dict[int, list[int]]:
    """Splits the nodes ``wide`` of the tops; returns the children that have to be split the same way."""
    k, bins = rules.classes, rules.bins
    options = {t: drawn(rules.seed, t, tops[t].heap[nodes], rules.features, rules.take) for t, nodes in wide.items()}
    counts, cuts = "_tree int, _option int, key binary, n binary", "_tree int, _option int, found binary"
    before = [tops[t] if t in wide else None for t in range(len(tops))]
    tree, nodes = next(iter(wide.items()))
    last = heap_depth(tops[tree].heap[nodes[0]]) + 1 == rules.max_depth   # all are of one level

    def count(batches):
        out = _arrow(counts)
        for block, x, y in _rows(batches):
            x, y = _unpacked(x), _unpacked(y).astype(np.int64)
            for tree, nodes in wide.items():
                top, w = before[tree], rules.bag(tree, block, len(y))
                number = np.full(len(top.feature), -1)
                number[nodes] = np.arange(len(nodes))
                slot = number[top.leaves(x)]
                rows = np.flatnonzero((slot >= 0) & (w > 0))
                slot = slot[rows]
                for j, option in enumerate(options[tree].T):
                    key, n = counted((slot * k + y[rows]) * bins + x[option[slot], rows], w[rows])
                    yield _batch(out, [(tree, j, _packed(key), _packed(n))])

    def choose(batches):
        out, held, at, key = _arrow(cuts), [], 0, None

        def merged():
            return counted(*(np.concatenate(v) for v in zip(*held)))

        def found():
            keys, n = merged()
            gain, cut = best_cuts(keys, n, k, bins)
            mix, left = keys // bins, keys % bins <= cut[keys // bins // k]
            sides = [counted(mix[side], n[side]) for side in (left, ~left, slice(None))]
            sizes = [np.bincount(a // k, b, len(gain)) for a, b in sides]
            # Counts by class go to the driver only of what may be a leaf.
            ends = [last | (np.bincount(a // k, minlength=len(gain)) == 1) for a, _ in sides[:2]] + [gain <= 0]
            sides = [(a[end[a // k]], b[end[a // k]]) for (a, b), end in zip(sides, ends)]
            return _batch(out, [(*key, pickle.dumps((gain, cut, sizes, sides)))])

        for tree, j, keys, n in _rows(batches):
            if (tree, j) != key:
                if key:
                    yield found()
                held, at, key = [], 0, (tree, j)
            held.append((_unpacked(keys), _unpacked(n)))
            at += len(held[-1][0])
            if at > MERGE_ROWS:
                held = [merged()]
                at = 0
        if key:
            yield found()

    parts = len(wide) * rules.take
    best: dict[int, list] = {}
    got = _streamed(blocks.select("_block", "x", "y").mapInArrow(count, counts), ["_tree", "_option"], [], choose, cuts, min(parts, 10_000))
    for tree, j, data in sorted(map(tuple, got.collect()), key=lambda r: r[:2]):
        best.setdefault(tree, []).append((j, *pickle.loads(data)))
    return {t: left for t, nodes in wide.items() if (left := _extended(tops, t, nodes, options[t], best[t], rules, local_rows))}


def _extended(tops, tree, nodes, options, found, rules, local_rows):
    """Puts the best cuts into the top of ``tree``; returns the children that are still wide."""
    top, k, more = tops[tree], rules.classes, []
    feature, cut, left, heap = (list(v) for v in (top.feature, top.cut, top.left, top.heap))
    votes = {i: (top.classes[a:b], top.shares[a:b]) for i, (a, b) in enumerate(zip(top.first, top.first[1:])) if b > a}

    def of(slot, side):
        keys, n = side
        here = keys // k == slot
        return keys[here] % k, n[here]

    for slot, node in enumerate(nodes):
        j, gain, cuts, sizes, sides = max(found, key=lambda f: f[1][slot])   # the first of equal ones
        if gain[slot] <= 0:
            classes, n = of(slot, sides[2])
            votes[node] = classes, n / n.sum()
            continue
        feature[node], cut[node], left[node] = options[slot][j], cuts[slot], len(feature)
        for i, side in enumerate(sides[:2]):
            child, (classes, n) = len(feature), of(slot, side)
            for column, value in zip((feature, cut, left, heap), (-1, 0, 0, 2 * heap[node] + i)):
                column.append(value)
            if len(classes):
                votes[child] = classes, n / n.sum()
            elif sizes[i][slot] > local_rows:
                more.append(child)
    none = np.zeros(0, np.int64), np.zeros(0)
    by_node = [votes.get(i, none) for i in range(len(feature))]
    tops[tree] = Tree(*(np.array(v) for v in (feature, cut, left, heap)), np.cumsum([0, *(len(c) for c, _ in by_node)]),
                      *(np.concatenate(v) for v in zip(*by_node)))
    return more
