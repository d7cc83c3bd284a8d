"""Operator 13 against plain Python (deletion and replacement holes over all words)."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from linkflow.llm import spelling
from linkflow.llm.common import load
from tests.conftest import SF_SMALL

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_forms(n):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
            if (shorter := w[:k] + w[k + 1:]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same if len(same) > 1 else ():
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def keyed(df):
    return {r[0]: tuple(r)[1:] for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, SF_SMALL, "documents").collect()]
    assert keyed(entry.queries()["op13_spelling"](spark, SF_SMALL)) == plain_forms(plain_words(docs))


@pytest.mark.parametrize("slice_words", [1 << 16, 10])
def test_dense_words_long_words_and_small_slices(spark, slice_words):
    rng = random.Random(5)
    n = {}
    for _ in range(3000):
        w = "".join(rng.choice("abcéz") for _ in range(rng.choice([7, 8, 8, 9, 31, 32, 33, 40, 300])))
        n[w] = rng.choice([2, 3, 30, 500])
        if rng.random() < 0.6:
            k = rng.randrange(len(w))
            other = rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1:]])
            if len(other) >= 7:
                n[other] = rng.choice([2, 5, 50])
    assert keyed(spelling.forms(spark.createDataFrame([*n.items()], "word string, n long"), slice_words)) == plain_forms(n)


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "Étranger étranger ÉTRANGER"), (3, "colouring COLOURING colouring,colorings"), (3, "colouring COLOURING colouring,colorings"), (4, "x" * 90_000 + " " + "x" * 89_999), (5, "x" * 90_000 + " " + "x" * 89_999),
            (6, "a×b÷c×dé a×b÷c×dé"), (7, "coloring " * 40), (8, "abcdefg1abcdefg_abcdefg"), (9, "İstanbulu ſtraßenß straßenß")]
    df = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, n int, word string, path int")
    assert keyed(spelling.variants(df)) == plain_forms(plain_words(rows))


def test_chains_are_followed_to_the_last_form(spark):
    n = {"aaaaaaa" + "b" * k: 2 * 10 ** k for k in range(9)}
    got = keyed(spelling.forms(spark.createDataFrame([*n.items()], "word string, n long")))
    assert got == plain_forms(n) and {v[1] for v in got.values()} == {"aaaaaaabbbbbbbb"}


def test_ties_take_the_smallest_form(spark):
    n = {"abcdefg": 2, "abcdefx": 20, "abcdefa": 20, "abcdefé": 20}
    assert keyed(spelling.forms(spark.createDataFrame([*n.items()], "word string, n long")))["abcdefg"] == ("abcdefa", "abcdefa", 2, 3, 20)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
