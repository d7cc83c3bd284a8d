"""Queries and pipeline: registration, and run() against its stages in plain Python."""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from linkflow.llm import quality
from linkflow.llm.common import load
from tests.conftest import SF_SMALL
from tests.llm.test_operators import BASE, plain_base, plain_groups, plain_leaks
from tests.llm.test_spelling import plain_forms, plain_words


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_the_rest_works_without_the_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "linkflow.llm.queries", None)
    monkeypatch.setattr(entry.importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError(name=name)))
    assert "pagerank" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert not any(n.startswith("op") for n in entry.oracle_sql())


def test_no_python_in_the_native_plan(spark):
    plan = entry.queries()["op4_pii"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_query_runs(spark, name):
    table = {"op1_url_filter": "pages", "op10_chat": "conversations", "op12_repair": "conversations"}.get(name, "documents")
    rows = load(spark, SF_SMALL, table)
    want = rows.select("conv_id").distinct().count() + (name == "op10_chat") if table == "conversations" else rows.count()
    got = entry.queries()[name](spark, SF_SMALL).count()
    if name == "op13_spelling":
        want = len(plain_forms(plain_words((r["doc_id"], r["text"]) for r in rows.collect())))
    assert 0 < got < want if name == "op6_decontaminate" else got == want


def test_pipeline_equals_its_stages(spark):
    docs = load(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rules = {"min_words": 50, "max_lost": 0.5, "max_symbol_share": 0.25, "nav_items": 4, "nav_words": 3}
    judged = [(i, quality.judge(t, **rules)) for i, t in rows]
    kept = [(i, j[-1]) for i, j in judged if j[-2]]
    single = [x for x, (i, n, c) in zip(kept, plain_groups(kept)) if not n or i == c]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    leaks = {r[0] for r in entry.queries()["op6_decontaminate"](spark, SF_SMALL).select("doc_id").collect()}
    assert got.keys() == {i for i, _ in single} - leaks
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got.values():
        assert r["ids"] == lib.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    private = {r["id"] for r in corpus_pipeline.pii.find(docs).where(F.size("spans") > 0).collect()}
    for i, t in single:
        if i in got:
            assert ("[" in got[i]["text"]) >= (i in private and t == dict(rows)[i])
            assert i in private or got[i]["text"] == t


def plain_masked(rows, rounds=2, min_support=5, min_confidence=0.8):
    """The texts of (id, text) with base and discovered spans masked, in plain Python."""
    kinds, run = [k for k, _ in BASE], re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?: [(]?[0-9]\S*)*", re.ASCII)
    base, runs, edges = [], [], {}
    for _, t in rows:
        spans = [x.split(":") for x in plain_base(t).split(",") if x]
        base.append([(int(s), kinds.index(k), int(e)) for k, s, e in spans])
        own = []
        for m in run.finditer(t):
            seed = next((k for s, k, e in base[-1] if s < m.end() and e > m.start()), -1)
            value = "".join(c for c in m[0] if c.isalpha() or c.isnumeric() or c in "@.").lower()
            left = re.search(r"([^\s0-9]+)\s*$", t[:m.start()], re.ASCII)
            right = re.match(r"\s*([^\s0-9]+)", t[m.end():], re.ASCII)
            for side, x in (("L", left), ("R", right)):
                if x:
                    edge = (side + x[1].lower(), value)
                    edges[edge] = max(edges.get(edge, -1), seed)
            own.append((m.start(), m.end(), value, seed))
        runs.append(own)
    seeds = {(v, k): 1.0 for (_, v), k in edges.items() if k >= 0}
    degree, score = Counter(p for p, _ in edges), dict(seeds)
    for _ in range(rounds):
        found, best = defaultdict(list), dict(seeds)
        for p, v in edges:
            for k in range(len(kinds)):
                if (v, k) in score:
                    found[p, k].append(score[v, k])
        for (p, v), seed in edges.items():
            for k in range(len(kinds)):
                x = found.get((p, k), [])
                if seed < 0 and len(x) >= min_support and sum(x) / (degree[p] + 1) >= min_confidence:
                    best[v, k] = max(best.get((v, k), 0), sum(x) / (degree[p] + 1))
        score = best
    kind = {}
    for (v, k), x in score.items():
        if x >= min_confidence:
            kind[v] = max(kind.get(v, (0, 0)), (x, -k))
    out = []
    for (_, t), spans, own in zip(rows, base, runs):
        at, parts = 0, []
        for s, k, e in sorted(spans + [(s, -kind[v][1], e) for s, e, v, seed in own if seed < 0 and v in kind]):
            if s >= at:
                parts += [t[at:s], f"[{kinds[k].upper()}]"]
            at = max(at, e)
        out.append("".join(parts) + t[at:])
    return out


def test_pipeline_texts_equal_plain_python(spark):
    """Leaks and spans of each stage's own input, none from the operators."""
    rules = {"min_words": 50, "max_lost": 0.5, "max_symbol_share": 0.25, "nav_items": 4, "nav_words": 3}
    judged = [(r["doc_id"], quality.judge(r["text"], **rules)) for r in load(spark, SF_SMALL, "documents").collect()]
    kept = [(i, j[-1]) for i, j in judged if j[-2]]
    single = [x for x, (i, n, c) in zip(kept, plain_groups(kept)) if not n or i == c]
    items = [(r["item_id"], r["text"]) for r in load(spark, SF_SMALL, "benchmark").collect()]
    leaks = {i for i, _ in plain_leaks(single, items)}
    clean = [(i, t) for i, t in single if i not in leaks]
    want = dict(zip((i for i, _ in clean), plain_masked(clean)))
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == want and any(t != want[i] for i, t in clean)


def test_stages_return_the_columns_of_documents(spark):
    docs = load(spark, SF_SMALL, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for source in (docs, docs.limit(0)):
            out = stage(spark, source, SF_SMALL)
            assert Counter(out.columns) == Counter(docs.columns) and out.count() <= 40
