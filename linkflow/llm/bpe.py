"""Operator 5, BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has exactly one last token in its encoding. For each
end position an automaton over all tokens yields the tokens that are suffixes
there, longest first; the first one that is compatible with the last token of
the prefix before it is stored, and back-pointers from the end give the ids.
Two adjacent tokens are compatible when byte-pair merging of their joined
bytes yields the two again: walking the right spine of the left token's merge
tree and the left spine of the right one's in the order in which merges
happen, no pair across the border may merge before both its sides are consumed.

Defined results: null or empty text: no ids and an empty text; repeated rows:
one result row each; an empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import MEMO_ENTRIES, Memo, hold, mapped, sliced
from linkflow.llm.vocab import ByPiece, Vocab, vocab

NEVER = 1 << 40


class Compatible(Memo):
    """(left << 32 | right) -> whether the two tokens may stand side by side."""

    def __init__(self, v: Vocab):
        super().__init__(self._test, longest=0, entries=1_000_000)
        self.v, self.right_spine, self.left_spine = v, {}, {}

    def __missing__(self, pair):
        if len(self) >= self.entries:
            self.clear()
        self[pair] = out = self.make(pair)
        return out

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(node, rank of the merge that consumes it), from the byte up."""
        out, end = [(token, NEVER)], token
        while part := self.v.parts.get(end):
            end = part[side]
            out.append((end, part[2]))
        return out[::-1]

    def _test(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        a = self.right_spine.get(left) or self.right_spine.setdefault(left, self._spine(left, 1))
        b = self.left_spine.get(right) or self.left_spine.setdefault(right, self._spine(right, 0))
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.v.ranks.get(x << 32 | y, NEVER)
            if rank < x_ends and rank <= y_ends:  # among equals the leftmost merges first
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class Recent(Memo):
    """A memo in two halves: when the newer one is full, the older one goes and
    what is asked for again moves on, so words in use are not made anew."""

    def __init__(self, make, longest: int = 64, entries: int = MEMO_ENTRIES):
        super().__init__(make, longest, entries // 2)
        self.older: dict = {}

    def __missing__(self, word):
        if (value := self.older.get(word)) is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Encoder:
    """Encodes and decodes texts; words seen before are looked up."""

    def __init__(self, path: str):
        self.v = v = vocab(path)
        self.compatible = Compatible(v)
        special = set(v.special.values())
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(v.tokens):
            if token and i not in special and (len(token) == 1 or i in v.parts):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.tokens = pa.array(v.tokens, pa.binary())
        self.pieces = ByPiece(lambda w: pack(f"<{len(ids := self.word_ids(w.encode()))}i", *ids), b"".join, MEMO_ENTRIES // 3)
        self.pieces.later = Recent(self._later, entries=MEMO_ENTRIES // 3)

    def _later(self, piece: str) -> bytes:
        """The ids of a piece and the space before it; one of ASCII letters is
        one word, and is remembered as a piece only."""
        if piece.isascii() and piece.isalpha():
            ids = self.word_ids(b" " + piece.encode())
            return pack(f"<{len(ids)}i", *ids)
        return self.pieces.whole(" " + piece)

    def word_ids(self, word: bytes) -> list[int]:
        n = len(word)
        if n == 1:
            return [self.v.byte_ids[word[0]]]
        last, length, compatible = [-1] * (n + 1), [0] * (n + 1), self.compatible
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            if last[end := end + 1] < 0:
                start = end - size
                if not start or ((left := last[start]) >= 0 and compatible[left << 32 | token]):
                    last[end], length[end] = token, size
        out = []
        while n:
            out.append(last[n])
            n -= length[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        out = []
        for k, run in enumerate(self.v.runs(text)):
            out += [np.array([self.v.special[run]], "<i4").tobytes()] if k % 2 else self.pieces.values(run)
        return b"".join(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ``ids`` cut at ``ends``, special tokens as their
        strings: the tokens' bytes are gathered in one buffer, cut by document."""
        parts = self.tokens.take(pa.array(ids))
        at = np.frombuffer(parts.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        whole = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(at[ends].astype(np.int32)), parts.buffers()[2] or pa.py_buffer(b""))
        try:
            whole.validate(full=True)
        except pa.ArrowInvalid:  # ids that stand for no UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in whole.cast(pa.binary()).to_pylist()], pa.string())
        return whole


def encoder(path: str) -> Encoder:
    return hold("bpe", path, make=lambda: Encoder(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string): each text's ids and the text
    that those ids decode to."""
    def run(batches):
        e = encoder(path)
        for b in sliced(batches):
            raw = [e.encode(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
            ids = np.frombuffer(b"".join(raw), "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), e.decode(ids, ends)], ["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = mapped(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
