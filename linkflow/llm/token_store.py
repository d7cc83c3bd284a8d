"""Operator 3, token-id output: an id array with Elias-Fano document bounds.

Texts are dealt out by ranges of the id column, encoded with the tokenizers
library, ended with an end id and written as *blocks*: rows of a Parquet
folder, so that any store Spark writes to will do and lost tasks are redone by
its committer. A block holds whole documents in ascending order until it has
``block_ids`` ids (a longer document is a block of its own):

- ``ids``: their ids one after the other, as little-endian integers of
  ``width`` bytes (2 if every id of the vocabulary fits, else 4);
- ``low``, ``high``: the documents' ends (ids before each end, ascending) in
  Elias-Fano code: the lowest ``low_bits`` bits of each end packed, the rest as
  a unary-coded bit vector, about 2 + log2(ids / documents) bits a document;
- ``select``: the position in ``high`` of every SELECT_EVERY-th one bit, so
  that one document's end is found by counting ones in a short stretch;
- ``part``, ``seq``: the task and the block within it, ``before``: the ids of
  the task's earlier blocks; ``docs``: the id column's values.

A second, small folder has the number of ids of each task; the reader adds up
those before a task (one number a task, never one a document) for the
documents' global starts.

Defined results: a null or empty text has the end id alone; null ids come
first; repeated ids and rows stay, ordered by text; an empty table gives no
blocks. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkflow.llm.common import MEMO_ENTRIES, hold, mapped, sliced

SELECT_EVERY = 64
#: Bytes of texts encoded together; parts that one text given to the library holds; bytes of parts that a worker remembers.
SLICE_BYTES, JOINED, MEMO_BYTES = 20 << 20, 64, 64 << 20
# Fixed values of the vocabulary's format: how the token that ends a word is
# marked, and the pre-tokens of lower-cased ASCII.
WORD_END = "</w>"
_ascii = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+")
BLOCK = "part int, seq long, before long, docs array<{kind}>, n_ids long, width int, ids binary, low_bits int, low binary, high binary, select array<long>"


class Encoder:
    """Ids as bytes. White space never joins into a token of this vocabulary,
    so texts are cut there, and ASCII pieces at every border of pre-tokens; each
    distinct part is encoded once, many in one call of the library: only the
    last id of a pre-token stands for a word's end, and a special string
    parts the pieces that have other characters."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ids = self.library.get_vocab(with_added_tokens=True)
        self.width = 2 if max(ids.values()) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.last = np.zeros(max(ids.values()) + 1, bool)
        self.last[[i for token, i in ids.items() if token.endswith(WORD_END)]] = True
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(self.library.get_added_tokens_decoder().items()) if t.special)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn(self, parts: list[bytes], between: str) -> None:
        """Adds the ids of ``parts``: pre-tokens (between: a space), or pieces
        with the special string between."""
        glue = between.encode()
        texts = [glue.join(parts[i:i + JOINED]).decode() for i in range(0, len(parts), JOINED)]
        found = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if between == self.mark:
            found = [np.append(x, self.kind.type(self.mark_id)) for x in found]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.mark_id if between == self.mark else self.last[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the library cuts these texts in other places")
        raw, begins = ids.tobytes(), (np.append(0, ends[:-1]) * self.width).tolist()
        ends = ((ends - 1 if between == self.mark else ends) * self.width).tolist()
        self.known.update(zip(parts, [raw[s:t] for s, t in zip(begins, ends)]))

    def _learn_pieces(self, new: list[bytes]) -> None:
        """Adds what stands between white space."""
        words, several, other, marked = set(), [], [], []
        for p in new:
            if b"<|" in p:
                marked.append(p)
            elif not p.isascii():
                other.append(p)
            elif p.isalpha() and p.islower():
                words.add(p)
            else:
                several.append((p, own := _ascii.findall(p.lower())))
                words.update(own)
        if words := [*words.difference(self.known)]:
            self._learn(words, " ")
        get = self.known.__getitem__
        self.known.update([(p, b"".join(map(get, own))) for p, own in several])
        if other:
            self._learn(other, self.mark)
        found = self.library.encode_batch_fast([p.decode() for p in marked], add_special_tokens=False)
        self.known.update((p, self.pack(e.ids)) for p, e in zip(marked, found))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none). Words are told apart by Arrow's
        dictionary encoding, so Python handles each one once a call."""
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        words = cut.flatten().dictionary_encode()
        parts = words.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > MEMO_ENTRIES or self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        own = [*map(self.known.get, parts)]
        missing = [i for i, x in enumerate(own) if x is None]
        new = [parts[i] for i in missing]
        self.held += sum(map(len, new))
        self._learn_pieces(new)
        for i, p in zip(missing, new):
            own[i] = self.known[p]
        sizes, pool = np.fromiter(map(len, own), np.int32, len(own)) // self.width, np.frombuffer(b"".join(own), self.kind)
        at = words.indices.to_numpy()
        begins, n = (np.cumsum(sizes, dtype=np.int32) - sizes)[at], sizes[at]  # a column has less than 2^31 bytes
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=ends[1:])
        raw = pool[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        bounds = (ends[cut.offsets.to_numpy()].astype(np.int64) * self.width).tolist()
        return [raw[s:t] for s, t in zip(bounds, bounds[1:])]


def encoder(path: str) -> Encoder:
    return hold("store", path, make=lambda: Encoder(path))


def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, list[int]]:
    """(low_bits, low, high, select) of ascending integers."""
    n = len(ends)
    low_bits = max(0, int(ends[-1] // n).bit_length() - 1) if n else 0
    low = (ends[:, None] >> np.arange(low_bits)) & 1
    ones = (ends >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_EVERY].tolist()


def ef_select(i: int, low_bits: int, low: bytes, high: bytes, select: list[int]) -> int:
    """The i-th value: one sampled position, then ones counted from there."""
    at, left = select[i // SELECT_EVERY], i % SELECT_EVERY
    while left:
        at += 1
        left -= high[at >> 3] >> (at & 7) & 1
    bits = range(i * low_bits, (i + 1) * low_bits)
    return (at - i) << low_bits | sum((low[b >> 3] >> (b & 7) & 1) << k for k, b in enumerate(bits))


def ef_values(n: int, low_bits: int, low: bytes, high: bytes) -> np.ndarray:
    """All n values at once."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    bits = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")[: n * low_bits].reshape(n, low_bits)
    return ((ones - np.arange(n)) << low_bits) + (bits.astype(np.int64) << np.arange(low_bits)).sum(axis=1)


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``folder``/blocks and ``folder``/totals."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("docs", pa.list_(arrow)), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("select", pa.list_(pa.int64()))])

    def blocks(batches):
        e = encoder(path)
        end, part = e.pack([end_id]), TaskContext.get().partitionId()
        names, held, sizes, seq, before = [], [], [], 0, 0

        def block():
            n = sum(sizes)
            row = [part, seq, before, names, n, e.width, b"".join(held), *ef_encode(np.array([*accumulate(sizes)], np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for b in (part for b in batches for part in sliced([b], -(-b.num_rows // (1 + b.column(1).nbytes // SLICE_BYTES)) or 1)):
            for name, raw in zip(b.column(0).to_pylist(), e.encode(b.column(1))):
                if names and sum(sizes) + len(raw) // e.width >= block_ids:
                    yield block()
                    seq, before = seq + 1, before + sum(sizes)
                    names, held, sizes = [], [], []
                names.append(name)
                held += raw, end
                sizes.append(len(raw) // e.width + 1)
        if names:
            yield block()

    ordered = slim.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    mapped(ordered, blocks, BLOCK.format(kind=kind), rows=10_000).write.parquet(f"{folder}/blocks")
    stored = docs.sparkSession.read.parquet(f"{folder}/blocks")
    stored.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{folder}/totals")


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id", end_id: int = 2) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document in the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted(map(tuple, spark.read.parquet(f"{folder}/totals").collect()))  # one number a task
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, accumulate([0, *(n for _, n in totals)]))], "part int, part_start long")

    def documents(batches):
        for b in sliced(batches, 1):
            r = b.to_pylist()[0]
            n = len(r["docs"])
            ends = ef_values(n, r["low_bits"], r["low"], r["high"])
            begins = np.concatenate([[0], ends[:-1]])
            ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
            if len(ids) != r["n_ids"] or (ids[ends - 1] != end_id).any():
                raise ValueError(f"damaged block {r['seq']} of part {r['part']}")
            crc = [zlib.crc32(ids[s:t].tobytes()) for s, t in zip(begins, ends)]
            first = r["part_start"] + r["before"]
            yield pa.RecordBatch.from_arrays([b.column(0).flatten(), pa.array(first + begins), pa.array(ends - begins), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    rows = blocks.join(F.broadcast(starts), "part").select("docs", "part", "seq", "before", "part_start", "n_ids", "width", "ids", "low_bits", "low", "high")
    return rows.mapInArrow(documents, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def id_at(spark: SparkSession, folder: str, part: int, seq: int, i: int) -> list[int]:
    """The ids of the i-th document of one block, through the select samples."""
    r = spark.read.parquet(f"{folder}/blocks").where((F.col("part") == part) & (F.col("seq") == seq)).first()
    at = lambda k: ef_select(k, r["low_bits"], r["low"], r["high"], r["select"]) if k >= 0 else 0
    return np.frombuffer(r["ids"], f"<u{r['width']}")[at(i - 1):at(i)].tolist()
