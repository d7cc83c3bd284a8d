"""Operator 12 against a plain search over all edits (least cost, then least audit)."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from linkflow.llm import repair
from linkflow.llm.common import load
from tests.conftest import SF_SMALL

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(initials, faults):
    """Uniform-cost search over (row, last role); the heap orders by cost, then audit."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(initials) and last in ("", "a"):
            return cost, audit
        given = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, given))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if faults[i] in (0, 3):
                extra = faults[i] == 3
                if initials[i] and initials[i] in NEXT[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials[i]))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, given))


def plain(rows):
    by = defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        own, role, text = by[conv], shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:16], r[2][:16], r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACES)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        cost, audit = cheapest(initials, faults)
        lines, last, i = [], "", 0
        for edit in audit:
            given = "a" if last == "u" else "u"
            if edit == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
            elif edit != "D":
                lines.append(f"{FULL[given]}:{own[i][2] if edit == 'R' else ''}")
            last = initials[i] if edit == "K" else last if edit == "D" else given
            i += edit != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
                     sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def keyed(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in load(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert keyed(entry.queries()["op12_repair"](spark, SF_SMALL)) == plain(rows)


@pytest.mark.parametrize("chunk", [1 << 16, 4, 1])
def test_nulls_ties_repeats_and_long_runs(spark, chunk):
    rng = random.Random(5)
    rows = [(conv, rng.choice([None, k, k, k, k + 1]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "sys"]),
             rng.choice(["hi.", "no", "what?", "", " \n", None, "a.b!", "x " * 50, "é."]))
            for conv in [None, *range(60)] for k in range(rng.choice([1, 2, 5, 12, 40]))]
    rows += rows[:7] + [(99, k, "user", "same." if k % 2 else f"text {k}") for k in range(300)] + [(98, None, "assistant", f"{k}!") for k in range(70)]
    df = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string, first boolean")
    assert keyed(repair.damage_and_repair(df, chunk=chunk)) == plain(rows)


def test_a_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = keyed(repair.damage_and_repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_other_id_types_and_names(spark):
    rows = [("a", 0, "user", "Hi."), ("b", 1, "assistant", "Yes."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "c string, t int, r string, x string")
    got = {r[0]: r["audit"] for r in repair.damage_and_repair(df, "c", "t", "r", "x").collect()}
    assert got == {k: v[6] for k, v in plain(rows).items()}


def test_powers_of_a_run_equal_its_single_steps():
    for symbol in (0, 1, 3, 4, 7, 8, 12, 15):
        for n in (1, 2, 3, 7, 100):
            one = repair.transition(bytes([symbol]))
            whole = one
            for _ in range(n - 1):
                whole = repair.product(whole, one)
            assert repair.transition(bytes([symbol]) * n) == whole


def test_a_long_conversation_is_sorted_over_several_tasks(spark):
    """A conversation with most rows lies in more than one task's range."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, -1L, id) AS conv", "id AS turn", "if(id % 6 = 0, 'user', 'assistant') AS role", "concat('row ', id, '.') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task else
    try:
        placed = repair.in_order(rows)
        assert placed.where("conv = -1").selectExpr("pos >> 33 AS task").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = repair.repair(rows.where("conv = -1"), chunk=1000).first()
    assert (got["cost"], len(got["audit"]), got["illegal"]) == (0, 20_000, 0)
