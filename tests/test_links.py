"""Link extraction, counts, degrees, adjacency and top lists."""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from linkflow.functions.links import LINE_LINK_PATTERN, decode_references
from linkflow.operators import linkgraph as lg
from linkflow.sources import tables as T
from tests.conftest import SF_SMALL


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "source STRING, target STRING")


# --- line regex ------------------------------------------------------------

LINE_CASES = [
    ('<a HREF="1.html"> x </a>', ["1.html"]),
    ('<a href="1.html"> x </a>', []),                      # lower-case href
    ('<a HREF="1.htm"> x </a>', []),                       # .htm
    ("<a HREF='2.html'> x </a>", ["2.html"]),              # single quotes
    ('<a x="1" HREF="3.html" HREF="4.html">', ["4.html"]),  # last HREF wins
    ('<A HREF="5.html">', []),                             # upper-case tag
    ('<a class="x" HREF="6.html"> a </a> <a HREF="7.html">', ["6.html", "7.html"]),
]


@pytest.mark.parametrize("line,expected", LINE_CASES)
def test_line_regex_cases(spark, line, expected):
    df = spark.createDataFrame([("f.html", line)], "file_name STRING, line STRING")
    got = [r.target for r in lg.links_from_lines(df).collect()]
    assert got == expected
    assert re.findall(LINE_LINK_PATTERN, line) == expected  # same as Python's re


def test_tag_over_two_lines_missed_per_line_found_whole(spark):
    text = '<a\n HREF="9.html"> x </a>'
    lines = spark.createDataFrame([("f", l) for l in text.split("\n")], "file_name STRING, line STRING")
    assert lg.links_from_lines(lines).count() == 0
    whole = spark.createDataFrame([("f", text)], "file_name STRING, line STRING")
    assert [r.target for r in lg.links_from_lines(whole).collect()] == ["9.html"]


# --- HTML links against the standard-library parser ------------------------

class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            value = None
            for k, v in attrs:  # last href wins
                if k == "href":
                    value = v
            if value:
                self.hrefs.append(value)


def _parser_links(doc):
    p = _Anchors()
    p.feed(doc)
    p.close()
    return p.hrefs


HTML_CASES = [
    '<a href="1.html">x</a><!-- <a href="2.html"> --><a HREF=\'3.html\'>',
    '<script>var s = "<a href=\\"4.html\\">";</script><a href=5.html>x</a>',
    '<style>a{}</style><a data-href="6.html" href="7.html">',
    '<a href="8.html" href="9.html">',
    '<a href="a.html?x=1&amp;y=2">',
    '<a href="">empty</a><a href>bare</a><article href="10.html">',
    '<A\nHREF = "11.html"\n>upper</A>',
    '<a title="x > y" href="12.html">',
    '<a title=\'q "z"\' href="/13.html">',
    '<a title=Bob\'s href="q.html">',
    '<a/href="s.html">',
    '<a href="14.html"><!-- <a href="15.html">',
    # character references
    '<a href="n&#49;.html">', '<a href="x&#x2e;html">', '<a href="a&eacute;.html">',
    '<a href="p&ampq.html">', '<a href="a&nbsp;b.html">', '<a href="&notit;&NotEqualTilde;">',
    '<A HREF="&amp;lt;">', '<a href="&#128;&#x9f;&#0;&#xD800;&#1114112;&#1;z">',
    # markup in which a tag is none
    '<![CDATA[<a href="cd.html">]]><a href="1">', '<? <a href="pi.html"><a href="2">',
    '<b title="<a href=1>"><a href=3>', '<!doctype html><a href=4>', '</x <a href="5"><a href=6>',
    '<script/><a href=9>', '<style><a href=10>', '<![if IE]><a href=12><![endif]>', '<!-- x -- ><a href=15>',
    "<a href = '11' title=\"<!--\">", '<title><!--</title><a href="--><a href=x>',
    # attributes
    '<a href="x" href>', '<a hrefx=1 href=13>', '<a data-x href="14"id=3>', '<a/>', '<a href=a/b/>',
    '<a title="a href=1" href=2>', '<a href="a&b=c&d">',
]


@pytest.mark.parametrize("doc", HTML_CASES)
def test_html_links_match_parser(spark, doc):
    df = spark.createDataFrame([("p.html", doc)], "file_name STRING, content STRING")
    got = [r.target for r in lg.links_from_documents(df, suffix=None).collect()]
    assert got == _parser_links(doc)


def test_references_match_the_library(spark):
    """Random mixes of references, names without semicolons and loose characters."""
    rng = random.Random(1)
    names = [*html5]
    parts = lambda: [*"&;#xX019aA <\t", "&#", "&#x", "&" + rng.choice(names), rng.choice(names), "&amp",
                     f"&#{rng.randrange(1_200_000)}", f"&#x{rng.randrange(0x120000):x}", "&#" + "9" * 30]
    values = ["".join(rng.choice(parts()) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    values += [f"&#{n};" for n in [*range(0, 0x200), 0xD7FF, 0xD800, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000]]
    values += [f"&{n}" for n in names]
    df = spark.createDataFrame([(v,) for v in [*values, "", None]], "v STRING")
    got = df.select("v", decode_references(F.col("v")).alias("d")).collect()
    assert [(r.v, r.d) for r in got if r.d != (r.v and unescape(r.v))] == []


def test_long_documents_are_cut_in_linear_time(spark):
    """Megabytes of unclosed markup, of links and of references in one row."""
    docs = ['<a href="' + "&eacute;" * 50_000 + '">', '<a href="x.html">' * 50_000, "<!-" * 300_000, "<a href='" * 100_000, "<" * 500_000, "&" * 500_000]
    df = spark.createDataFrame([(str(k), d) for k, d in enumerate(docs)], "file_name STRING, content STRING")
    got = lg.links_from_documents(df, suffix=None).groupBy("source").agg(F.count("*"), F.max(F.length("target"))).collect()
    assert {tuple(r) for r in got} == {("0", 1, 50_000), ("1", 50_000, 6)}


def test_html_links_on_driver_pages_match_parser(spark):
    files = T.files(spark, SF_SMALL)
    got = Counter((r.source, r.target) for r in lg.links_from_documents(files, suffix=None).collect())
    want = Counter()
    for r in files.collect():
        for h in _parser_links(r.content):
            want[(r.file_name[:-5], h)] += 1
    assert got == want and sum(want.values()) > 0


def test_html_suffix_filter_strips_page_ids(spark):
    doc = '<a href="1.html">a</a><a href="2.htm">b</a><a href="/x">c</a><a href="1.html">d</a>'
    df = spark.createDataFrame([("dir/7.html", doc)], "file_name STRING, content STRING")
    got = sorted(tuple(r) for r in lg.links_from_documents(df).collect())
    assert got == [("7", "1"), ("7", "1")]


# --- counts and degrees ----------------------------------------------------

def test_counts_keep_duplicates_and_self_links(spark):
    e = _edges(spark, [("a", "b"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "c")])
    occ = {r.target: r.occurrences for r in lg.inlink_occurrences(e).collect()}
    dist = {r.target: r.sources for r in lg.inlink_distinct(e).collect()}
    both = {r.target: (r.occurrences, r.sources) for r in lg.inlink_counts(e).collect()}
    assert occ == {"b": 4, "c": 1}
    assert dist == {"b": 3, "c": 1}
    assert both == {k: (occ[k], dist[k]) for k in occ}
    assert all(occ[k] >= dist[k] for k in occ)


def test_out_degree_includes_zero_pages_in_degree_does_not(spark):
    e = _edges(spark, [("a", "b"), ("a", "b"), ("b", "a")])
    pages = spark.createDataFrame([("a",), ("b",), ("z",)], "page STRING")
    out = {r.page: r.out_degree for r in lg.out_degree(e, pages).collect()}
    assert out == {"a": 2, "b": 1, "z": 0}
    ind = {r.page: r.in_degree for r in lg.in_degree(e).collect()}
    assert ind == {"b": 2, "a": 1}
    assert sum(ind.values()) == sum(out.values()) == e.count()


def test_degree_sums_equal_edge_count_on_links_view(spark):
    links = T.links(spark, SF_SMALL)
    n = links.count()
    assert lg.in_degree(links).agg(F.sum("in_degree")).first()[0] == n
    assert lg.out_degree(links).agg(F.sum("out_degree")).first()[0] == n


def test_adjacency_chunks_cover_full_lists(spark):
    pairs = [("hub", str(i)) for i in range(40)] + [("hub", "3"), ("x", "hub")]
    e = _edges(spark, pairs)
    adj = lg.adjacency(e, chunk_size=8).collect()
    hub_out = [r for r in adj if r.page == "hub" and r.direction == "out"]
    assert len(hub_out) >= 3                      # split over several rows
    merged = Counter()
    for r in hub_out:
        for nb in r.neighbours:
            merged[nb.page] += nb.links
    assert merged == Counter(t for s, t in pairs if s == "hub")
    hub_in = [r for r in adj if r.page == "hub" and r.direction == "in"]
    assert [(n.page, n.links) for r in hub_in for n in r.neighbours] == [("x", 1)]


def test_top_k_ties_and_short_input(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "target STRING, n BIGINT")
    got = [(r.target, r.n, r.position) for r in lg.top_k(df, "n", "target", 5).collect()]
    assert got == [("a", 3, 1), ("b", 3, 2), ("c", 1, 3)]


def test_adjacency_lists_pages_without_links(spark):
    pages = spark.createDataFrame([("a",), ("alone",)], "page STRING")
    adj = {(r.page, r.direction): len(r.neighbours) for r in lg.adjacency(_edges(spark, [("a", "b")]), pages).collect()}
    assert adj == {("a", "out"): 1, ("a", "in"): 0, ("b", "in"): 1, ("alone", "out"): 0, ("alone", "in"): 0}


def test_link_graph_merges_both_sides(spark):
    """Pages without links, NULL pages, one-sided pages and a hub's chunks."""
    edges = [("a", "b"), ("a", "b"), ("b", None), (None, "c"), *(("hub", f"t{k}") for k in range(500))]
    pages = spark.createDataFrame([("a",), ("alone",), (None,), ("alone",)], "page STRING")
    got = lg.link_graph(_edges(spark, edges), pages, chunk_size=100).collect()
    sides = {}
    for r in got:
        out, into = sides.setdefault(r.page, ([], []))
        out += [(n.page, n.links) for n in r.outgoing]
        into += [(n.page, n.links) for n in r.incoming]
    assert len(sides) == 506 and len(got) == len({(r.page, r.chunk) for r in got})
    assert sides["alone"] == ([], []) and sides["a"] == ([("b", 2)], []) and sides["c"] == ([], [(None, 1)])
    assert sides[None] == ([("c", 1)], [("b", 1)]) and sides["b"] == ([(None, 1)], [("a", 2)])
    assert sorted(sides["hub"][0]) == sorted((f"t{k}", 1) for k in range(500))
    assert max(len(r.outgoing) for r in got) < 200
