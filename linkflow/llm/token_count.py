"""Operator 9, token counts: heap-and-linked-list byte-pair merging.

A word's bytes form a doubly linked list; a heap yields the adjacent pair of
lowest rank (leftmost first among equals). A popped pair whose symbols have
changed meanwhile is stale and skipped. The count is the number of initial
symbols minus the merges done; no identifiers are emitted.

Defined results: null or empty text: 0 bytes, 0 tokens, not over the limit;
repeated rows: one result row each; an empty table: no rows. Only the id and
text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced
from linkflow.llm.vocab import ByPiece, Vocab, vocab


def merged_count(word: bytes, v: Vocab) -> int:
    """Tokens that byte-pair merging leaves of ``word``."""
    n = len(word)
    if n < 2:
        return n
    pair_rank, made, pop, push = v.ranks.get, v.made, heapq.heappop, heapq.heappush
    symbol = [v.byte_ids[b] for b in word]
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    symbol.append(-1)  # the list's end: it is in no pair
    heap = [rank << 32 | i for i in range(n - 1) if (rank := pair_rank(symbol[i] << 32 | symbol[i + 1])) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        item = pop(heap)
        i, rank = item & 0xFFFFFFFF, item >> 32
        left, j = symbol[i], after[i]
        if left < 0 or pair_rank(left << 32 | symbol[j]) != rank:  # merged into another, or its neighbour changed
            continue
        done += 1
        symbol[i] = left = made[rank]
        symbol[j] = -2
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := pair_rank(left << 32 | symbol[k])) is not None:
                push(heap, rank << 32 | i)
        h = before[i]
        if h >= 0 and (rank := pair_rank(symbol[h] << 32 | left)) is not None:
            push(heap, rank << 32 | h)
    return n - done


class Counter:
    """Counts of texts; words seen before are looked up."""

    def __init__(self, path: str):
        self.v = vocab(path)
        self.pieces = ByPiece(lambda w: merged_count(w.encode(), self.v), sum)

    def count(self, text: str) -> int:
        total = 0
        for k, run in enumerate(self.v.runs(text)):
            total += 1 if k % 2 else sum(self.pieces.values(run))
        return total


def counter(path: str) -> Counter:
    return hold("counts", path, make=lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    def count(batches):
        c = counter(path)
        for b in sliced(batches):
            n = [c.count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["id"].dataType.simpleString()
    out = mapped(slim, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
