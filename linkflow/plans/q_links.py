"""Link-graph queries: extraction, counts, degrees, statistics, PageRank."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkflow.functions.format import rank_report, stats_report
from linkflow.functions.links import (
    ATTRIBUTE, LINE_LINK_PATTERN, MARKUP_PLAIN,
)
from linkflow.operators import linkgraph as lg
from linkflow.operators.pagerank import pagerank, pagerank_run
from linkflow.operators import sketches as SK
from linkflow.operators.stats import degree_stats
from linkflow.plans.catalog import register, sql_str
from linkflow.session import scratch_path
from linkflow.sources import tables as T
from linkflow.sources.sinks import read_table, write_report, write_table

# --- SQL building blocks for the oracles ------------------------------------

LINKS_REGEX_SQL = (
    "SELECT file_name AS source, unnest(regexp_extract_all(line, "
    f"{sql_str(LINE_LINK_PATTERN)}, 1)) AS target FROM html_lines")

# Named references over column u (those of the driver's pages; links_references
# has the others), '&amp;' last, which one pass from left to right amounts to.
_ENTITY_DECODE = ("replace(replace(replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), "
                  "'&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')")

# One href per tag (the last one); tags without href drop out.
LINKS_HTML_SQL = f"""
SELECT source, target FROM (
  SELECT source, {_ENTITY_DECODE} AS target FROM (
    SELECT source,
           CASE WHEN length(h) >= 2 AND ((h LIKE '"%' AND h LIKE '%"') OR (h LIKE '''%' AND h LIKE '%'''))
                THEN substr(h, 2, length(h) - 2) ELSE h END AS u
    FROM (
      SELECT CASE WHEN file_name LIKE '%.html' THEN left(file_name, length(file_name) - 5)
                  ELSE file_name END AS source,
             hs[-1] AS h
      FROM (
        SELECT file_name,
               list_filter(list_transform(range(1, len(names) + 1),
                   lambda i: CASE WHEN lower(names[i]) = 'href' THEN coalesce(vals[i], '') END),
                   lambda x: x IS NOT NULL) AS hs
        FROM (
          SELECT file_name,
                 regexp_extract_all(substr(tag, 3), {sql_str(ATTRIBUTE)}, 1) AS names,
                 regexp_extract_all(substr(tag, 3), {sql_str(ATTRIBUTE)}, 2) AS vals
          FROM (
            SELECT file_name,
                   unnest(regexp_extract_all(content, {sql_str(MARKUP_PLAIN)}, 1)) AS tag
            FROM files)
          WHERE tag <> ''))
      WHERE len(hs) > 0)))
WHERE target <> ''
"""

# --- extraction -------------------------------------------------------------


@register("links_regex", T.with_views(LINKS_REGEX_SQL, "html_lines"))
def links_regex(spark, sf_dir):
    return lg.links_from_lines(T.html_lines(spark, sf_dir))


@register("links_html", T.with_views(LINKS_HTML_SQL, "files"))
def links_html(spark, sf_dir):
    # The driver pages link to '/word' paths, never to '.html' files, so the
    # page-suffix filter is off here; with it on the result would be empty.
    return lg.links_from_documents(T.files(spark, sf_dir), suffix=None)


# Markup that holds no link, and a link written with every kind of reference to
# characters that follow from the row's numbers.
_REFERENCE_DOC = """'<!-- <a href="no.html"> --><![CDATA[<a href="no.html">]]><? <a href="no.html">'
    || '<b title="<a href=no.html>"><a class=x href="&#' || CAST(200 + l_partkey % 40000 AS STRING)
    || ';&#x' || hex(161 + l_suppkey % 500) || ';&eacute;&ampq&notit;&amp;lt;' || CAST(l_linenumber AS STRING) || '">'"""


@register("links_references", """SELECT CAST(l_orderkey AS VARCHAR) AS source,
       chr(CAST(200 + l_partkey % 40000 AS INTEGER)) || chr(CAST(161 + l_suppkey % 500 AS INTEGER))
         || 'é&q¬it;&lt;' || CAST(l_linenumber AS VARCHAR) AS target
FROM lineitem""")
def links_references(spark, sf_dir):
    """Links whose targets are written with character references."""
    docs = T.table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) || '.html' AS file_name", f"{_REFERENCE_DOC} AS content")
    return lg.links_from_documents(docs, suffix=None)


# --- counts on the regex links (line-based link counter) --------------------

_LK = [("lk", LINKS_REGEX_SQL)]


@register("inlink_occurrences", T.with_views(
    "SELECT target, count(*) AS occurrences FROM lk GROUP BY target", "html_lines", ctes=_LK))
def inlink_occurrences(spark, sf_dir):
    return lg.inlink_occurrences(links_regex(spark, sf_dir))


@register("inlink_distinct", T.with_views(
    "SELECT target, count(DISTINCT source) AS sources FROM lk GROUP BY target",
    "html_lines", ctes=_LK))
def inlink_distinct(spark, sf_dir):
    return lg.inlink_distinct(links_regex(spark, sf_dir))


@register("inlink_counts", T.with_views(
    "SELECT target, count(*) AS occurrences, count(DISTINCT source) AS sources "
    "FROM lk GROUP BY target", "html_lines", ctes=_LK))
def inlink_counts(spark, sf_dir):
    """Both counts from one aggregate (the links feed both without a cache)."""
    return lg.inlink_counts(links_regex(spark, sf_dir))


def _top5_sql(value: str, inner: str) -> str:
    return T.with_views(
        f"SELECT target, {value}, CAST(row_number() OVER (ORDER BY {value} DESC, target) AS INTEGER)"
        f" AS position FROM ({inner}) ORDER BY {value} DESC, target LIMIT 5",
        "html_lines", ctes=_LK)


@register("top5_inlink_distinct", _top5_sql(
    "sources", "SELECT target, count(DISTINCT source) AS sources FROM lk GROUP BY target"))
def top5_inlink_distinct(spark, sf_dir):
    return lg.top_k(inlink_distinct(spark, sf_dir), "sources", "target", 5)


@register("top5_inlink_occurrences", _top5_sql(
    "occurrences", "SELECT target, count(*) AS occurrences FROM lk GROUP BY target"))
def top5_inlink_occurrences(spark, sf_dir):
    return lg.top_k(inlink_occurrences(spark, sf_dir), "occurrences", "target", 5)


@register("sink_top", T.with_views(
    """SELECT 'top_incoming' AS list, target, sources AS n, position FROM (
         SELECT target, sources, CAST(row_number() OVER (ORDER BY sources DESC, target) AS BIGINT) AS position
         FROM (SELECT target, count(DISTINCT source) AS sources FROM lk GROUP BY target))
       WHERE position <= 5
       UNION ALL
       SELECT 'top_outgoing' AS list, target, occurrences AS n, position FROM (
         SELECT target, occurrences, CAST(row_number() OVER (ORDER BY occurrences DESC, target) AS BIGINT) AS position
         FROM (SELECT target, count(*) AS occurrences FROM lk GROUP BY target))
       WHERE position <= 5""", "html_lines", ctes=_LK))
def sink_top(spark, sf_dir):
    """Both top lists written as JSON rows to the shared folder, read back.

    One aggregate gives both counts per target; only that table (one row per
    target) is cached for the two top-k passes, never the edges.
    """
    counts = lg.inlink_counts(lg.links_from_lines(T.html_lines(spark, sf_dir))).cache()
    try:
        incoming = lg.top_k(counts.select("target", "sources"), "sources", "target", 5)
        outgoing = lg.top_k(counts.select("target", "occurrences"), "occurrences", "target", 5)
        rows = (incoming.select(F.lit("top_incoming").alias("list"), "target",
                                F.col("sources").alias("n"), "position")
                .unionByName(outgoing.select(F.lit("top_outgoing").alias("list"), "target",
                                             F.col("occurrences").alias("n"), "position")))
        path = write_report(rows, scratch_path(spark, "top-lists"), ["list", "position"])
    finally:
        counts.unpersist()
    return spark.read.schema("list STRING, target STRING, n BIGINT, position BIGINT").json(path)


# --- degrees, adjacency and statistics on the `links` view ------------------

@register("in_degree", T.with_views(
    "SELECT target AS page, count(*) AS in_degree FROM links GROUP BY target", "links"))
def in_degree(spark, sf_dir):
    return lg.in_degree(T.links(spark, sf_dir))


@register("out_degree", T.with_views(
    "SELECT source AS page, count(*) AS out_degree FROM links GROUP BY source", "links"))
def out_degree(spark, sf_dir):
    return lg.out_degree(T.links(spark, sf_dir))


@register("adjacency", T.with_views(
    f"""SELECT page, direction, chunk,
               string_agg(nb || '*' || CAST(links AS VARCHAR), ',' ORDER BY nb) AS neighbours
        FROM (
          SELECT page, direction, nb, links,
                 CAST(('0x' || substr(md5(nb), 1, 8)) AS BIGINT)
                   % CAST(ceil(count(*) OVER (PARTITION BY page, direction) / {lg.ADJACENCY_CHUNK}.0) AS BIGINT)
                   AS chunk
          FROM (SELECT page, direction, nb, count(*) AS links FROM (
                  SELECT source AS page, 'out' AS direction, target AS nb FROM links
                  UNION ALL
                  SELECT target AS page, 'in' AS direction, source AS nb FROM links)
                GROUP BY page, direction, nb))
        GROUP BY page, direction, chunk""", "links"))
def adjacency(spark, sf_dir):
    adj = lg.adjacency(T.links(spark, sf_dir))
    return adj.select("page", "direction", "chunk",
                      lg.render_neighbours(F.col("neighbours")).alias("neighbours"))


STATS_SQL = """SELECT count(*) AS pages, avg(d) AS avg, max(d) AS max, min(d) AS min,
       quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.2) AS p20,
       quantile_cont(d, 0.4) AS p40, quantile_cont(d, 0.6) AS p60,
       quantile_cont(d, 0.8) AS p80
FROM ({inner})"""


@register("in_degree_stats", T.with_views(STATS_SQL.format(
    inner="SELECT count(*) AS d FROM links GROUP BY target"), "links"))
def in_degree_stats(spark, sf_dir):
    return degree_stats(lg.in_degree(T.links(spark, sf_dir)), "in_degree")


@register("out_degree_stats", T.with_views(STATS_SQL.format(
    inner="SELECT count(*) AS d FROM links GROUP BY source"), "links"))
def out_degree_stats(spark, sf_dir):
    return degree_stats(lg.out_degree(T.links(spark, sf_dir)), "out_degree")


def _sketched(spark, sf_dir):
    """Sketches of the in-degrees by slices of the pages, written and read back
    (as a job that adds slice to slice would find them)."""
    degrees = lg.in_degree(T.links(spark, sf_dir))
    parts = degrees.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(32)))
    path = write_table(SK.degree_sketches(parts, "in_degree", ["part"]), scratch_path(spark, "degree-sketches"))
    return degrees, read_table(spark, path)


def _report_sql(value: str, label: str) -> str:
    return f"""SELECT unnest([
         printf('Average {label} Links: %.4f', avg), 'Max {label}: ' || max, 'Min {label}: ' || min, 'Median {label}: ' || median,
         printf('20th Percentile: %.4f', p20), printf('40th Percentile: %.4f', p40),
         printf('60th Percentile: %.4f', p60), printf('80th Percentile: %.4f', p80)]) AS line
       FROM ({STATS_SQL.format(inner=f"SELECT count(*) AS d FROM links GROUP BY {value}")})"""


@register("degree_report", T.with_views(
    f"SELECT 'in' AS list, line FROM ({_report_sql('target', 'Incoming')}) "
    f"UNION ALL SELECT 'out', line FROM ({_report_sql('source', 'Outgoing')})", "links"))
def degree_report(spark, sf_dir):
    """Both degree statistics as report lines with fixed decimals."""
    lines = lambda stats, label, name: stats_report(stats, label).select(F.lit(name).alias("list"), "line")
    return lines(in_degree_stats(spark, sf_dir), "Incoming", "in").unionByName(
        lines(out_degree_stats(spark, sf_dir), "Outgoing", "out"))


_EXACT = ["pages", "avg", "max", "min"]


@register("degree_sketch_stats", T.with_views(
    """SELECT unnest(['pages', 'avg', 'max', 'min', 'median', 'p20', 'p40', 'p60', 'p80']) AS statistic,
              unnest([CAST(count(*) AS DOUBLE), avg(d), max(d), min(d), NULL, NULL, NULL, NULL, NULL]) AS value,
              TRUE AS within
       FROM (SELECT count(*) AS d FROM links GROUP BY target)""", "links"))
def degree_sketch_stats(spark, sf_dir):
    """The exact figures of the merged sketches, and for each percentile whether
    its true rank is within the stated error."""
    degrees, sketches = _sketched(spark, sf_dir)
    stats = SK.sketch_stats(sketches)
    exact = stats.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in _EXACT))).alias("at", "value"))
    exact = exact.select(F.array(*map(F.lit, _EXACT))[F.col("at")].alias("statistic"), "value", F.lit(True).alias("within"))
    within = SK.within_error(stats, degrees, "in_degree", SK.rank_error())
    return exact.unionByName(within.withColumn("value", F.lit(None).cast("double")))


# --- PageRank (two unrolled rounds = the 'sum' stop rule on this data) ------

def _round_sql(prev: str, name: str) -> str:
    return f"""{name}_raw AS (
  SELECT n.page, 0.15 + 0.85 * coalesce(c.inflow, 0.0) AS raw
  FROM nodes n LEFT JOIN (
    SELECT l.target AS page, sum(p.rank / o.d) AS inflow
    FROM links l JOIN {prev} p ON l.source = p.page JOIN outdeg o ON l.source = o.page
    GROUP BY l.target) c ON n.page = c.page),
{name} AS (SELECT page, raw / (SELECT sum(raw) FROM {name}_raw) AS rank FROM {name}_raw)"""


PAGERANK_CTES = f"""WITH links AS ({T.view_sql('links')}),
crawled AS (SELECT DISTINCT source AS page FROM links),
nodes AS (SELECT source AS page FROM links UNION SELECT target FROM links),
outdeg AS (SELECT source AS page, CAST(count(*) AS DOUBLE) AS d FROM links GROUP BY source),
r0 AS (SELECT n.page, CASE WHEN c.page IS NOT NULL THEN CAST(0.01 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS rank
       FROM nodes n LEFT JOIN crawled c ON n.page = c.page),
{_round_sql('r0', 'r1')},
{_round_sql('r1', 'r2')}
"""


def _rank_rounded():
    return F.round(F.col("rank"), 9).alias("rank")


@register("pagerank", PAGERANK_CTES + "SELECT page, round(rank, 9) AS rank FROM r2")
def pagerank_query(spark, sf_dir):
    ranks = pagerank(T.links(spark, sf_dir), threshold=0.005, stop="sum")
    return ranks.select("page", _rank_rounded())


@register("pagerank_top5", PAGERANK_CTES + """
SELECT page, rank, CAST(row_number() OVER (ORDER BY rank DESC, page) AS INTEGER) AS position
FROM (SELECT page, round(rank, 9) AS rank FROM r2) ORDER BY rank DESC, page LIMIT 5""")
def pagerank_top5(spark, sf_dir):
    ranks = pagerank(T.links(spark, sf_dir), threshold=0.005, stop="sum")
    return lg.top_k(ranks.select("page", _rank_rounded()), "rank", "page", 5)


@register("pagerank_convergence", PAGERANK_CTES + """
SELECT CAST(1 AS INTEGER) AS round, round(sum(abs(r1.rank - r0.rank)), 6) AS difference FROM r1 JOIN r0 USING (page)
UNION ALL
SELECT CAST(2 AS INTEGER), round(sum(abs(r2.rank - r1.rank)), 6) FROM r2 JOIN r1 USING (page)""")
def pagerank_convergence(spark, sf_dir):
    """The L1 difference of each round, from a run that is stopped after one
    round and resumed in the same folder."""
    links, folder = T.links(spark, sf_dir), scratch_path(spark, "pagerank")
    pagerank_run(links, stop="l1", threshold=0.0, max_iter=1, folder=folder)
    run = pagerank_run(links, stop="l1", threshold=0.0, max_iter=2, folder=folder)
    return run.history.select("round", F.round("difference", 6).alias("difference"))


@register("rank_report", PAGERANK_CTES + """
SELECT printf('Rank %d: %s, Score %.12f', position, page, rank) AS line
FROM (SELECT page, rank, CAST(row_number() OVER (ORDER BY rank DESC, page) AS INTEGER) AS position
      FROM (SELECT page, round(rank, 9) AS rank FROM r2)) WHERE position <= 5""")
def rank_report_query(spark, sf_dir):
    """The top five as report lines."""
    return rank_report(pagerank_top5(spark, sf_dir))
