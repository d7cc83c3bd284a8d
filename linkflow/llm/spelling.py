"""Operator 13, spelling variant grouping: a frequency-vector trie.

Words are the runs of Latin letters of all texts; two are near if exactly one
inserted, deleted or replaced letter tells them apart. Such an edit changes the
numbers of letters by group by one surplus and one deficit at most.

*Trie.* A word's path has its number of letters in each of GROUPS letter groups
one after the other. A search goes down the trie with a budget of one surplus
and one deficit, spends them where a child's count is one more or one less,
and ends at nodes of at most LEAF words, which are then verified letter by letter.

*Distribution.* The first levels are COARSE counts, in which a word is put by
all its letters: a word is indexed under its own path and asks there and under
the paths that a word with one more letter, or one with a letter replaced,
may have. Of two paths that differ one asks the other only (the shorter word, or that
with more letters in the lowest coarse group that differs), so a pair is
found once. Paths with more than SLICE words are cut into slices, each of which
gets all that ask there, so a worker holds one slice's trie and no word is left out.
Within a worker the words of many paths make one trie (the path is its first
level); queries go down in blocks, deepest block first, so memory is bounded.

*Forms.* A word's form is the near word of largest count (ties: smallest in
code-point order), if at least RATIO times its own; forms are followed by
doubling steps: counts grow by RATIO at each step, so chains are short.

The counted table ``damaged_words`` is that of the query's contract: a run is
lower-cased (A-Z only) and loses a letter where 31 divides the crc32 of ``id:run``.

Defined results: null and empty texts have no words; a null id is written as
nothing (``:run``); repeated rows count again; very long runs are words like
others; an empty table has no words. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced, small, utf8, written

LETTERS, LEAST_LETTERS, LEAST_COUNT, DAMAGED, RATIO = r"A-Za-zÀ-ÿ", 7, 2, 31, 10
#: Letter groups of the trie (code point modulo), coarse groups of the shuffle key, words of a leaf.
GROUPS, COARSE, LEAF = 32, 4, 8
#: Words of a path's slice; queries that go down together; pairs verified at once.
SLICE, ASKING, VERIFIED = 1 << 16, 1 << 14, 1 << 18
#: Words up to this length are verified as rows of a matrix, longer ones alone.
ROW = 32
ANY, NONE = COARSE, COARSE + 1
#: What a coarse count of one adds to a path, modulo 2 ** 64.
UNIT = [1 << (64 // COARSE * k) for k in range(COARSE)]
ROWS = "path long, slice int, asks boolean, word binary, n long"


def words_of(text: bytes, doc_id) -> Counter:
    """The results of a text's runs that may be words, with their counts."""
    text = text.lower().decode()  # bytes.lower knows ASCII only
    out, lead = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_run.findall(text)).items():
        h = zlib.crc32(run.encode(), lead)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


_run = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): results of at least 7 letters that occur at least twice in all."""
    def run(batches):
        hold()
        for b in sliced(batches):
            found: Counter = Counter()
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found.update(words_of(t, i))
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["word", "n"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = mapped(slim, run, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which word, letter) of all letters."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)


def vectors(raw: list[bytes], groups: int) -> np.ndarray:
    """Numbers of letters by group."""
    word, letter = letters(raw)
    return np.bincount(word * groups + letter % groups, minlength=len(raw) * groups).reshape(len(raw), groups)


def paths(raw: list[bytes]) -> np.ndarray:
    """The coarse path of each word (Latin-1 bytes)."""
    return (vectors(raw, COARSE).astype(np.uint64) * np.array(UNIT, np.uint64)).sum(axis=1, dtype=np.uint64)


def steps() -> list[tuple[int, int, int]]:
    """(change of the path, surplus, deficit) of what a word asks: its own path,
    that of one more letter in a coarse group, that of a letter of a coarse group
    replaced by one of a later group."""
    more = [(UNIT[j], j, NONE) for j in range(COARSE)]
    replaced = [((UNIT[j] - UNIT[i]) % (1 << 64), j, i) for i in range(COARSE) for j in range(i + 1, COARSE)]
    return [(0, ANY, NONE), *more, *replaced]


def placed(words: DataFrame, slice_words: int = SLICE) -> DataFrame:
    """ROWS of each word: one to be found, one for each path it asks."""
    to = np.array([change for change, _, _ in steps()], np.uint64)

    def run(batches):
        hold()
        for b in sliced(batches, ASKING):
            raw = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            own, n = paths(raw), np.arange(len(raw))
            path = np.concatenate([own, (own[:, None] + to).ravel()])
            which = np.concatenate([n, np.repeat(n, len(to))])
            asks = np.arange(len(path)) >= len(raw)
            words = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(asks), words.take(pa.array(which)), b.column(1).take(pa.array(which))], ["path", "asks", "word", "n"])

    rows = words.select("word", "n").mapInArrow(run, "path long, asks boolean, word binary, n long")
    rows = written(rows, "spelling-rows")
    big = rows.where("NOT asks").groupBy("path").agg(F.count("*").alias("held")).where(F.col("held") > slice_words)
    big = small(written(big.select("path", F.ceil(F.col("held") / slice_words).cast("int").alias("slices")), "spelling-big"))
    slices = F.coalesce("slices", F.lit(1))
    dealt = F.when(F.col("asks"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), slices).cast("int")))
    return rows.join(big, "path", "left").select("path", F.explode(dealt).alias("slice"), "asks", "word", "n")


class Trie:
    """Words by bundle (their path and slice) and then by letter groups.

    Words are sorted, so a node is a stretch of them; ``levels`` has, for each
    level, the sorted keys (parent, count) of its nodes and where they begin."""

    def __init__(self, bundle: np.ndarray, raw: list[bytes]):
        vector = vectors(raw, GROUPS)
        self.order = np.lexsort([*vector.T[::-1], bundle])
        self.vector = vector = vector[self.order].astype(np.int32)
        self.packed = packed(vector)
        self.bundles, first = np.unique(bundle[self.order], return_index=True)
        self.starts, self.levels = np.append(first, len(raw)), []
        node = np.repeat(np.arange(len(first)), np.diff(self.starts))
        starts = self.starts
        for g in range(GROUPS):
            if np.diff(starts).max() <= LEAF:
                break
            key = node << 32 | vector[:, g].astype(np.int64)
            new = np.append(True, np.diff(key) != 0)
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            starts = np.append(first, len(raw))
            self.levels.append((key[first], starts))

    def search(self, bundle: np.ndarray, vector: np.ndarray, up: np.ndarray, down: np.ndarray):
        """Blocks (query, word) whose vectors differ in two groups at most.
        ``up``, ``down``: the coarse group in which the query may spend its
        surplus and its deficit, ANY or NONE. A surplus spent on ANY has its deficit
        in the same coarse group, later on: the other word finds the reverse."""
        root, flat = np.searchsorted(self.bundles, bundle), packed(vector)
        at = np.flatnonzero(self.bundles[np.minimum(root, len(self.bundles) - 1)] == bundle)
        for k in range(0, len(at), ASKING):
            q = at[k:k + ASKING]
            stack = [(0, q, root[q], up[q], down[q])]
            while stack:
                level, q, node, up_, down_ = stack.pop()
                starts = self.levels[level - 1][1] if level else self.starts
                size = starts[node + 1] - starts[node]
                leaf = size <= (LEAF if level < len(self.levels) else len(self.order))
                yield from self._leaves(q[leaf], starts[node[leaf]], size[leaf], flat)
                if leaf.all():
                    continue
                q, node, up_, down_ = (x[~leaf] for x in (q, node, up_, down_))
                keys, group = self.levels[level][0], level % COARSE
                key = node << 32 | vector[q, level]
                child = np.searchsorted(keys, key)  # children are in a row: one less is the one before, one more after it
                equal = np.take(keys, child, mode="clip") == key
                goes = [(equal, child, up_, down_)]
                may = np.flatnonzero((up_ == group) | (up_ == ANY))
                more = child[may] + equal[may]
                may, more = (x[np.take(keys, more, mode="clip") == key[may] + 1] for x in (may, more))
                goes.append((may, more, np.full(len(may), NONE, np.int8), np.where(up_[may] == ANY, group, down_[may]).astype(np.int8)))
                may = np.flatnonzero(down_ == group)
                less = child[may] - 1
                hit = (less >= 0) & (np.take(keys, less, mode="clip") == key[may] - 1)
                goes.append((may[hit], less[hit], up_[may[hit]], np.full(hit.sum(), NONE, np.int8)))
                below = [np.concatenate(x) for x in zip(*((q[w], c if k else c[w], u if k else u[w], d if k else d[w]) for k, (w, c, u, d) in enumerate(goes)))]
                for s in range(0, len(below[0]), 4 * ASKING):
                    stack.append((level + 1, *(x[s:s + 4 * ASKING] for x in below)))

    def _leaves(self, q: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray):
        ends = np.cumsum(size)
        for s in range(0, len(q), step := max(1, VERIFIED // max(1, int(size.max(initial=1))))):
            n, end = size[s:s + step], ends[s:s + step]
            query, first = np.repeat(q[s:s + step], n), end[0] - n[0]
            word = np.repeat(start[s:s + step] - (end - n), n) + np.arange(first, end[-1])
            near = groups_that_differ(self.packed[word], flat[query]) <= 2
            yield query[near], word[near]


def packed(vector: np.ndarray) -> np.ndarray:
    """Counts modulo 256, eight to an integer."""
    return np.ascontiguousarray(vector.astype(np.uint8)).view(np.uint64)


def groups_that_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bytes in which rows differ: each is made one high bit."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    differ = a ^ b
    return np.bitwise_count((((differ & low) + low) | differ) & ~low).sum(axis=1)


def matrices(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, letters from the left, letters from the right), ROW wide."""
    pad = b"\0" * ROW
    left = np.frombuffer(b"".join([(w[:ROW] + pad)[:ROW] for w in raw]), np.uint8).reshape(-1, ROW)
    right = np.frombuffer(b"".join([(pad + w[-ROW:])[-ROW:] for w in raw]), np.uint8).reshape(-1, ROW)
    return np.fromiter(map(len, raw), np.int64, len(raw)), left, right


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter tells them apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def verified(a: int | np.ndarray, b: np.ndarray, of_a, of_b, raw_a: list[bytes], raw_b: list[bytes]) -> np.ndarray:
    """Of the pairs (a, b) of rows which are near."""
    (na, la, ra), (nb, lb, rb) = of_a, of_b
    m, n = na[a], nb[b]
    left, right = la[a] != lb[b], ra[a] != rb[b]
    lead = np.where(left.any(axis=1), left.argmax(axis=1), ROW)
    trail = np.where(right.any(axis=1), right[:, ::-1].argmax(axis=1), ROW)
    near = np.where(m == n, left.sum(axis=1) == 1, (np.abs(m - n) == 1) & (lead + trail >= np.minimum(m, n)))
    for k in np.flatnonzero(np.maximum(m, n) > ROW):
        near[k] = one_edit(raw_a[a[k]], raw_b[b[k]])
    return near


def near_pairs(rows: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of near words, both ways round."""
    changes = np.array([c for c, _, _ in steps()], np.uint64)
    order = np.argsort(changes)
    ways = np.array([(u, d) for _, u, d in steps()], np.int8)[order]

    def run(batches):
        hold()
        held: tuple[list, list, list] = ([], [], [])  # the index rows of the last bundle so far
        last = None
        for batch in batches:
            for b in sliced([batch], 1 << 16):
                path, part, asks = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                raw, n = b.column(3).to_pylist(), b.column(4).to_pylist()
                bundle = np.cumsum(np.append(0, (np.diff(path) != 0) | (np.diff(part) != 0)))
                index = np.flatnonzero(~asks).tolist()
                same = last == (path[0], part[0])
                words, counts, where = held if same else ([], [], [])
                words, counts = words + [raw[k] for k in index], counts + [n[k] for k in index]
                where = np.append(np.zeros(len(where), int), bundle[index]).astype(int)
                keep = np.flatnonzero(where == bundle[-1]).tolist()
                held, last = ([words[k] for k in keep], [counts[k] for k in keep], keep), (path[-1], part[-1])
                query = np.flatnonzero(asks).tolist()
                if not query or not words:
                    continue
                own = [raw[k] for k in query]
                trie, of_own, of_words = Trie(where, words), matrices(own), matrices(words)
                way = np.searchsorted(changes[order], path[query].view(np.uint64) - paths(own))
                vector = vectors(own, GROUPS)
                for q, w in trie.search(bundle[query], vector, *ways[way].T):
                    near = verified(q, trie.order[w], of_own, of_words, own, words)
                    q, w = q[near], w[near]
                    change = trie.vector[w] - vector[q]
                    first = np.take_along_axis(change, (change != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
                    first[ways[way[q], 0] != ANY] = 1  # found from this side only
                    pairs = [(k, j) for k, j, sign in zip(q.tolist(), trie.order[w].tolist(), first.tolist()) if sign > 0 or not sign and own[k] < words[j]]
                    a, c = [own[k] for k, _ in pairs], [words[j] for _, j in pairs]
                    na, nc = [n[query[k]] for k, _ in pairs], [counts[j] for _, j in pairs]
                    texts = [x.decode("latin-1") for x in a], [x.decode("latin-1") for x in c]
                    yield pa.RecordBatch.from_arrays([pa.array(texts[0] + texts[1], pa.string()), pa.array(texts[1] + texts[0], pa.string()), pa.array(nc + na, pa.int64())], ["word", "near", "near_n"])

    dealt = rows.repartition("path", "slice").sortWithinPartitions("path", "slice", "asks")
    return mapped(dealt.select("path", "slice", "asks", "word", "n"), run, "word string, near string, near_n long", rows=SLICE)


def forms(words: DataFrame, slice_words: int = SLICE, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n)."""
    pairs = near_pairs(placed(words, slice_words))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = written(found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "spelling-near")
    formed = F.col("near_n") >= ratio * F.col("n")
    out = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    out = written(out, "spelling-forms")
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "spelling-roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = roots.join(on, "root")
        if ahead.isEmpty():
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """forms() of the damaged words of ``docs``."""
    return forms(written(damaged_words(docs, id_col, text_col), "spelling-words"))
