"""Operator 11, SimHash near-dedup: pigeonring filtering.

A document's fingerprint has a bit for each of 64 positions: set if it is set
in over half of the XXH64 values (seed 42) of the document's 4-word shingles.
Documents link when their fingerprints differ in at most RADIUS = 4 bits.

*Ring.* The fingerprint is cut into five segments, taken as a ring. If two
fingerprints differ in at most 4 bits, there is a segment from which every
chain of l consecutive segments has at most l * 4 / 5 differences, rounded
down: 0, 1, 2, 3, 4 for l = 1 to 5 (the strong form of the pigeonring
principle). So the pair agrees in that segment and differs in at most one bit
of the next one.

*Candidates.* For each of the five starts a fingerprint has one index row, keyed
by the start and the 26 bits of the chain of two. It probes that key and, for each
set bit of the second segment, the key without it: of two fingerprints that
differ there in one bit, exactly one has it. A pair that meets is pruned by
the budgets of the chains of three and four before its full distance counts.

*Dense keys.* A key with more than HOT fingerprints is not joined, as its links
could be all pairs: its index rows are dealt to slices of about SLICE, each of its
probes goes to every slice, and a worker streams the probes past the slice
it holds, keeping of the links that it finds a spanning forest. So every pair
of a key is compared, none is listed beyond HOT a probe, and no task holds
more than a slice.

Equal fingerprints (copies, texts without words) are one node throughout.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; repeated ids and rows keep their rows; null ids link like others,
and a component without any id has a null component_id; an empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced, small, utf8, written
from linkflow.llm.graph import components

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: (lowest bit, bits) of the segments; the ring goes on from the last to the first.
RING = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
WIDTH = 13
HOT, SLICE = 16, 4096
#: Shingles whose bits are counted at once; pairs that a worker compares at once.
COUNTED, COMPARED = 1 << 16, 1 << 20


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned integer; bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    ends = ends[WORDS - 1:] if len(words) > WORDS else ends[-1:]
    starts, ends, digest = starts[:len(ends)].tolist(), ends.tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), COUNTED):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + COUNTED], ends[at:at + COUNTED])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print long) of each row of ``docs``."""
    def run(batches):
        hold()
        for b in sliced(batches):
            prints = np.array([fingerprint(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["id", "print"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return mapped(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, print long")


def _mask(start: int, chain: int) -> int:
    """The bits of ``chain`` segments from ``start`` on, as a signed long."""
    parts = (RING[(start + k) % len(RING)] for k in range(chain))
    bits = sum(((1 << n) - 1) << low for low, n in parts)
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


#: For a chain of three and of four: the mask from each start.
MASKS = {chain: [_mask(start, chain) for start in range(len(RING))] for chain in (3, 4)}


def _segment(value: Column, k: int) -> Column:
    low, n = RING[k % len(RING)]
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1))


def _key(start: int, first: Column, second: Column) -> Column:
    return F.lit(start << 2 * WIDTH) + F.shiftleft(first, WIDTH) + second


def index_rows(prints: DataFrame) -> DataFrame:
    """(key, print): a row for each start of the ring."""
    keys = [_key(i, _segment(F.col("print"), i), _segment(F.col("print"), i + 1)) for i in range(len(RING))]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def probe_rows(index: DataFrame) -> DataFrame:
    """(key, print, own): the index rows themselves, and the keys without one
    of the set bits of their second segment."""
    bit = F.explode(F.array(*(F.lit(1 << b).cast("long") for b in range(WIDTH)))).alias("bit")
    flips = index.select("key", "print", bit).where(F.col("key").bitwiseAND(F.col("bit")) != 0)
    flips = flips.select((F.col("key") - F.col("bit")).alias("key"), "print", F.lit(False).alias("own"))
    return index.select("key", "print", F.lit(True).alias("own")).unionByName(flips)


def within_budgets(key: Column, a: Column, b: Column) -> Column:
    """Whether a chain of the ring from the key's start keeps its budgets."""
    differ, start = a.bitwiseXOR(b), F.shiftright(key, 2 * WIDTH)
    chain = lambda k: F.bit_count(differ.bitwiseAND(F.element_at(F.array(*map(F.lit, MASKS[k])), (start + 1).cast("int"))))
    budget = lambda k: k * RADIUS // len(RING)
    return (chain(3) <= budget(3)) & (chain(4) <= budget(4)) & (F.bit_count(differ) <= RADIUS)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links (a, b) some that connect all that they connect."""
    root: dict[int, int] = {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := top(x)) != (q := top(y)):
            root[p] = q
            kept.append((x, y))
    return [x for x, _ in kept], [y for _, y in kept]


def slice_links(rows: DataFrame) -> DataFrame:
    """(a, b): links of the probes with the index rows of their (key, slice);
    ``rows`` has key, slice, probe (false: an index row), own, print."""
    masks = {k: np.array(m, np.int64).view(np.uint64) for k, m in MASKS.items()}

    def run(batches):
        hold()
        at, held = None, []  # the (key, slice) and its index rows
        for b in batches:
            key, part, probe, own, prints = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            prints = prints.view(np.uint64)
            bounds = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *bounds.tolist()], [*bounds.tolist(), len(key)]):
                if at != (key[s], part[s]):
                    at, held = (key[s], part[s]), []
                held.append(prints[s:e][~probe[s:e]])
                index, asking = np.concatenate(held), np.flatnonzero(probe[s:e]) + s
                held, start = [index], int(key[s]) >> 2 * WIDTH
                step = max(1, COMPARED // max(1, len(index)))
                for k in range(0, len(asking), step):
                    p = asking[k:k + step]
                    differ = prints[p][:, None] ^ index
                    near = np.bitwise_count(differ) <= RADIUS
                    near &= ~own[p][:, None] | (prints[p][:, None] < index)
                    for chain, mask in masks.items():
                        near &= np.bitwise_count(differ & mask[start]) <= chain * RADIUS // len(RING)
                    x, y = np.nonzero(near)
                    if len(x):
                        a, c = _forest(prints[p][x].view(np.int64), index[y].view(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    dealt = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "probe")
    return dealt.select("key", "slice", "probe", "own", "print").mapInArrow(run, "a long, b long")


def links(prints: DataFrame, hot: int = HOT, slice_rows: int = SLICE) -> DataFrame:
    """(a, b): links that connect all that is connected among the distinct ``prints``."""
    index = index_rows(prints)
    dense = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    dense = small(written(dense.select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")), "simhash-dense"))
    probes = probe_rows(index)
    p, x = probes.join(dense, "key", "left_anti").alias("p"), index.join(dense, "key", "left_anti").alias("x")
    once = ~F.col("p.own") | (F.col("p.print") < F.col("x.print"))
    met = p.join(x, (F.col("p.key") == F.col("x.key")) & once & within_budgets(F.col("p.key"), F.col("p.print"), F.col("x.print")))
    sparse = met.select(F.col("p.print").alias("a"), F.col("x.print").alias("b"))
    held = index.join(dense, "key").select("key", F.pmod(F.xxhash64("print"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("probe"), F.lit(False).alias("own"), "print")
    asking = probes.join(dense, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("probe"), "own", "print")
    return sparse.unionByName(slice_links(held.unionByName(asking)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, slice_rows: int = SLICE) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row of ``docs``."""
    rows = written(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = written(rows.groupBy("print").agg(F.min("id").alias("least")), "simhash-nodes")
    comp = components(links(nodes.select("print"), hot, slice_rows))
    nodes = written(nodes.join(comp, nodes["print"] == comp["node"], "left").select("print", "least", F.coalesce("comp", "print").alias("comp")), "simhash-members")
    lead = written(nodes.groupBy("comp").agg(F.min("least").alias("component_id")), "simhash-leads")
    of_print = written(nodes.join(lead, "comp").select("print", "component_id"), "simhash-components")
    shown = F.lower(F.lpad(F.hex("print"), BITS // 4, "0"))
    return rows.join(of_print, "print").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
