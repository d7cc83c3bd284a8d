"""Operator 6, benchmark decontamination: SimHash of item-sized windows.

Texts and items are lower-cased runs of letters and digits; shingles have five
words (a shorter item is one shingle). For each item length every window of
that many words that holds a shingle of such an item gets a 128-bit SimHash,
each shingle voting once for each time it occurs. Windows without any shared shingle have similarity 0 and
need none. A document with fewer words than an item, but enough to reach the
similarity, is itself the one window. Fingerprints are cut into BLOCKS blocks of 16 bits: a window within
RADIUS bits of an item agrees with it to within RADIUS // BLOCKS bits in at least
one block, so the blocks, compared by themselves, find every item within the
radius. Each is then verified exactly: the sum of the
smaller counts of each shingle over the sum of the larger ones is at least
``similarity``.

A window of similarity 0.75 differs from the item in about 22 of 128 bits
(standard deviation 4.3); RADIUS 44 is five deviations above.

The benchmark is a stated query set: its items are taken in blocks of
BLOCK_ITEMS or BLOCK_BYTES, each broadcast with the task, against all documents.

Defined results: a null or empty text or item matches nothing; ids of items and
documents may be of any type, and null; repeated items and documents give a row each; the best window (the first among equals) stands for
a document and an item; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced, small, written

SHINGLE, BITS, BLOCKS, RADIUS = 5, 128, 8, 44
#: Items, and bytes of their texts, that are compared in one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 4 << 20
#: Pairs of a window and an item that are compared at once.
COMPARED = 1 << 18
_token = re.compile(r"\w+")
_prime = np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words (all words, if fewer)."""
    size = min(size, len(words))
    if not size:
        return words
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h + words[k:len(words) - size + 1 + k] * _prime)
    return h


def votes(h: np.ndarray) -> np.ndarray:
    """+1 or -1 of each shingle for each bit."""
    halves = np.stack([mix(h), mix(h + _prime)], axis=1)
    return np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def within_radius(marks: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, bits that differ) of the pairs within RADIUS: candidates
    agree in some block up to RADIUS // BLOCKS bits (of unrelated prints 59 %
    do, measured), and their whole distance is tested."""
    candidates = np.zeros((len(marks), len(prints)), bool)
    for b in range(BLOCKS):
        candidates |= np.bitwise_count(marks[:, b, None] ^ prints[:, b]) <= RADIUS // BLOCKS
    w, i = np.nonzero(candidates)
    far = np.bitwise_count(marks[w] ^ prints[i]).sum(axis=1)
    near = far <= RADIUS
    return w[near], i[near], far[near]


class Items:
    """The items of one block, by their number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for key, text in items:
            words = hashed(_token.findall((text or "").lower()))
            if len(words):
                groups.setdefault(len(words), []).append((key, words))
        self.groups = []
        for n, own in groups.items():
            sets = [shingles(w) for _, w in own]
            prints = np.packbits(np.stack([votes(s).sum(axis=0, dtype=np.int32) > 0 for s in sets]), axis=1)
            self.groups.append((n, [k for k, _ in own], [Counter(s.tolist()) for s in sets], prints.view(np.uint16), np.unique(np.concatenate(sets))))
        known = self.known = np.unique(np.concatenate([g[4] for g in self.groups] or [np.array([], np.uint64)]))
        self.shorter = [g for g in self.groups if g[0] < SHINGLE]
        self.maybe = np.zeros(1 << 22, bool)  # whether a shingle may be an item's
        self.maybe[known & np.uint64(len(self.maybe) - 1)] = True

    def find(self, words: np.ndarray, similarity: float) -> list[tuple]:
        """(item, first word, words, bits that differ, similarity) of each item found."""
        out, full = [], shingles(words) if len(words) >= SHINGLE else np.array([], np.uint64)
        hot = np.flatnonzero(self.maybe[full & np.uint64(len(self.maybe) - 1)])
        hot = hot[among(full[hot], self.known)]
        for n, keys, counts, prints, known in self.groups if len(hot) else self.shorter:
            size = min(n, len(words))
            if size < n and (size < SHINGLE or (size - SHINGLE + 1) / (n - SHINGLE + 1) < similarity):
                continue  # not even a copy of a part is similar enough
            own = full if n >= SHINGLE else shingles(words, n)
            at = hot if n >= SHINGLE else np.arange(len(own))
            at = at[among(own[at], known)]
            if not len(at):
                continue
            span, last = max(1, size - SHINGLE + 1), len(words) - size
            starts = np.unique((at[:, None] - np.arange(span)).ravel())
            starts = starts[(starts >= 0) & (starts <= last)]
            best: dict[int, tuple] = {}
            for begin in range(0, len(starts), 4096):
                s = starts[begin:begin + 4096]
                low = int(s[0])
                sums = np.cumsum(np.vstack([np.zeros((1, BITS), np.int32), votes(own[low:int(s[-1]) + span])]), axis=0, dtype=np.int32) if s[-1] - low < 65536 else None
                total = sums[s - low + span] - sums[s - low] if sums is not None else np.stack([votes(own[x:x + span]).sum(axis=0, dtype=np.int32) for x in s])
                marks = np.packbits(total > 0, axis=1).view(np.uint16)
                for first in range(0, len(keys), step := max(1, COMPARED // len(s))):
                    for w, i, far in zip(*(x.tolist() for x in within_radius(marks, prints[first:first + step]))):
                        here, item = Counter(own[s[w]:s[w] + span].tolist()), counts[i := first + i]
                        both = (here & item).total()
                        found = both / (here.total() + item.total() - both)
                        if found >= similarity and (i not in best or found > best[i][4]):
                            best[i] = (keys[i], int(s[w]), size, far, found)
            out += best.values()
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, first_word, n_words, bits, similarity): each document
    with each item that one of its windows matches."""
    items = benchmark.select(F.monotonically_increasing_id().alias("ordinal"), F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    items = written(items, "benchmark-items")  # an id of any type stays in Spark: workers know ordinals
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, ordinal long, first_word int, n_words int, bits int, similarity double"
    spark, found, block, size = docs.sparkSession, None, [], 0

    def against(own: list) -> DataFrame:
        held = spark.sparkContext.broadcast(own)

        def run(batches):
            hold()
            index = Items(held.value)
            for b in sliced(batches):
                kinds = [b.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                rows = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows += [(key, *r) for r in index.find(hashed(_token.findall((text or "").lower())), similarity)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "ordinal", "first_word", "n_words", "bits", "similarity"])

        return mapped(slim, run, schema)

    for row in items.select("ordinal", "text").toLocalIterator():  # the query set, a block at a time
        block.append((row["ordinal"], row["text"]))
        size += len(row["text"] or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            found, block, size = against(block) if found is None else found.unionByName(against(block)), [], 0
    if block or found is None:
        found = against(block) if found is None else found.unionByName(against(block))
    named = found.join(small(items.select("ordinal", "item")), "ordinal")
    return named.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "n_words", "bits", "similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    hits = written(contaminated(keyed, benchmark, id_col="__text", **options).select(F.col("__text").alias("__hit")).distinct(), "leaks")
    return keyed.join(small(hits), F.expr("__text = __hit"), "left_anti").drop("__text")
