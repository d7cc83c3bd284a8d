"""The crawl flow end to end on all of the given pages.

pages -> HTML links -> PageRank top 5, in-degree and out-degree statistics. A
node is a page id or a link target as written (no ``href`` of the driver's
pages names one of the pages); every page is crawled, so a page
without links counts with an out-degree of 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkflow.operators import linkgraph as lg
from linkflow.operators.pagerank import pagerank
from linkflow.operators.stats import degree_stats
from linkflow.plans.catalog import register
from linkflow.plans.q_links import LINKS_HTML_SQL, STATS_SQL
from linkflow.sources import tables as T

_CTES = f"""crawled AS (SELECT left(file_name, length(file_name) - 5) AS page FROM files),
links AS ({LINKS_HTML_SQL}),
nodes AS (SELECT page FROM crawled UNION SELECT target FROM links),
outdeg AS (SELECT source AS page, CAST(count(*) AS DOUBLE) AS d FROM links GROUP BY source),
r0 AS (SELECT n.page, CASE WHEN c.page IS NOT NULL THEN CAST(0.01 AS DOUBLE)
                           ELSE CAST(0.0 AS DOUBLE) END AS rank
       FROM nodes n LEFT JOIN crawled c ON n.page = c.page)"""


def _sql(body: str, rounds: str = "") -> str:
    return T.with_views("", "files").rstrip() + f",\n{_CTES}{rounds}\n{body}"


def _round(prev: str, name: str) -> str:
    return f""",
{name}_raw AS (
  SELECT n.page, 0.15 + 0.85 * coalesce(c.inflow, 0.0) AS raw
  FROM nodes n LEFT JOIN (
    SELECT l.target AS page, sum(p.rank / o.d) AS inflow
    FROM links l JOIN {prev} p ON l.source = p.page JOIN outdeg o ON l.source = o.page
    GROUP BY l.target) c ON n.page = c.page),
{name} AS (SELECT page, raw / (SELECT sum(raw) FROM {name}_raw) AS rank FROM {name}_raw)"""


def _crawl(spark, sf_dir):
    files = T.files(spark, sf_dir)
    crawled = files.select(F.expr("left(file_name, length(file_name) - 5)").alias("page"))
    return crawled, lg.links_from_documents(files, suffix=None)


@register("corpus_pagerank_top5", _sql("""SELECT page, rank,
       CAST(row_number() OVER (ORDER BY rank DESC, page) AS INTEGER) AS position
FROM (SELECT page, round(rank, 9) AS rank FROM r2) ORDER BY rank DESC, page LIMIT 5""", _round("r0", "r1") + _round("r1", "r2")))
def corpus_pagerank_top5(spark, sf_dir):
    crawled, links = _crawl(spark, sf_dir)
    # Two rounds, as the sum rule takes unless the start sum is near 1.
    ranks = pagerank(links, crawled, threshold=0.0, stop="l1", max_iter=2)
    return lg.top_k(ranks.withColumn("rank", F.round("rank", 9)), "rank", "page", 5)


@register("corpus_in_degree_stats", _sql(STATS_SQL.format(inner="SELECT count(*) AS d FROM links GROUP BY target")))
def corpus_in_degree_stats(spark, sf_dir):
    _, links = _crawl(spark, sf_dir)
    return degree_stats(lg.in_degree(links), "in_degree")


@register("corpus_out_degree_stats", _sql(STATS_SQL.format(inner="""SELECT count(l.source) AS d FROM crawled c
                            LEFT JOIN links l ON l.source = c.page GROUP BY c.page""")))
def corpus_out_degree_stats(spark, sf_dir):
    crawled, links = _crawl(spark, sf_dir)
    return degree_stats(lg.out_degree(links, crawled), "out_degree")


@register("links_page_suffix", T.with_views("""SELECT left(file_name, length(file_name) - 5) AS source,
       left(href, length(href) - 5) AS target
FROM (SELECT file_name, regexp_extract(line, '(?i)href="([^"]*)"', 1) AS href FROM html_lines)
WHERE href LIKE '%.html'""", "html_lines"))
def links_page_suffix(spark, sf_dir):
    """Page links of HTML text: only targets with the page suffix, without it."""
    return lg.links_from_documents(T.html_lines(spark, sf_dir), content_col="line")


_LIST = """string_agg(nb || '*' || CAST(links AS VARCHAR), ',' ORDER BY nb)"""


@register("link_graph", _sql(f"""SELECT page, chunk,
       coalesce({_LIST} FILTER (WHERE direction = 'out'), '') AS outgoing,
       coalesce({_LIST} FILTER (WHERE direction = 'in'), '') AS incoming
FROM (
  SELECT page, direction, nb, links,
         CAST(('0x' || substr(md5(nb), 1, 8)) AS BIGINT)
           % CAST(ceil(count(*) OVER (PARTITION BY page, direction) / {lg.ADJACENCY_CHUNK}.0) AS BIGINT) AS chunk
  FROM (SELECT source AS page, 'out' AS direction, target AS nb, count(*) AS links FROM links GROUP BY ALL
        UNION ALL
        SELECT target, 'in', source, count(*) FROM links GROUP BY ALL)
  UNION ALL
  SELECT page, 'none', NULL, NULL, 0 FROM crawled WHERE page NOT IN (SELECT source FROM links) AND page NOT IN (SELECT target FROM links))
GROUP BY page, chunk"""))
def link_graph(spark, sf_dir):
    """Out- and in-lists of every page, crawled pages without links included."""
    crawled, links = _crawl(spark, sf_dir)
    graph = lg.link_graph(links, crawled)
    return graph.select("page", "chunk", lg.render_neighbours(F.col("outgoing")).alias("outgoing"),
                        lg.render_neighbours(F.col("incoming")).alias("incoming"))
