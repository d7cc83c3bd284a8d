"""Operator 11 against plain Python: fingerprints, links, nulls, dense keys."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkflow.llm import graph, simhash
from linkflow.llm.common import load
from tests.conftest import SF_SMALL

WORD = re.compile("[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    grams = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, ids):
    """The least id of each row's component, by comparing all pairs."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return [least.get(top(p)) for p in prints]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(got, rows):
    prints = [plain_print(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components(prints, [i for i, _ in rows]))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, SF_SMALL, "documents").collect()]
    check(entry.queries()["op11_simhash"](spark, SF_SMALL).collect(), rows)


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"word{k % 997}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "A b C"), (5, "a B c"), (5, "a B c"), (6, "É b c d"), (7, "é b c d"), (8, long), (9, long + " end"), (9, "other words stand here now"),
            (None, "x y z"), (None, "X Y Z"), (10, "x\x85y z w"), (11, "x\xa0y z w v"), (-3, "x" * 70_000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, print int, component_id string, key int")
    got = simhash.groups(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    check(got.collect(), rows)


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hot, slice_rows", [(128, 4096), (0, 50), (10, 7)])
def test_dense_clusters(spark, hot, slice_rows):
    """Clusters around centres; few or all keys are dense, slices are small."""
    rng = random.Random(3)
    prints = set()
    for k in range(40):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(150 if k < 4 else 0):
            near = centre
            for _ in range(rng.randint(1, 6)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    comp = graph.components(simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), hot, slice_rows))
    got = {r["node"]: r["comp"] for r in comp.collect()}
    want = plain_components(prints, [signed(p) for p in prints])
    assert [got.get(signed(p), signed(p)) for p in prints] == want


def test_every_pair_within_the_radius_keeps_a_chain():
    """Strong pigeonring: some start has budgets 0, 1, 2, 3, 4."""
    rng = random.Random(4)
    for _ in range(20_000):
        bits = rng.sample(range(64), rng.randint(0, 4))
        per = [sum(low <= b < low + n for b in bits) for low, n in simhash.RING]
        assert any(all(sum(per[(s + k) % 5] for k in range(length)) <= length * 4 // 5 for length in range(1, 6)) for s in range(5))


def test_a_hot_text_is_one_node_and_links_are_bounded(spark):
    """A third of the rows are copies; near prints of a dense key emit a forest."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words for a third of all rows").otherwise(F.concat(F.lit("text of row "), F.col("id"))).alias("text"))
    got = simhash.groups(docs).where("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    near = [sum(1 << b for b in bits) for bits in [(), *((k,) for k in range(40)), *((k, j) for k in range(40) for j in range(k))]]
    found = simhash.links(spark.createDataFrame([(p,) for p in near], "print long"), hot=8, slice_rows=64)
    assert found.count() < 200 * len(near)
    assert graph.components(found).select("comp").distinct().count() == 1
