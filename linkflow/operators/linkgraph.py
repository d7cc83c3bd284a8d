"""Link graph: edges from pages, link counts, degrees, adjacency, top lists.

The edge table ``(source, target)`` is the primary form; duplicates and
self-links are kept (multigraph). Every count is a hash aggregate with a
map-side partial step, so a hub page that holds a large share of all links is
reduced inside each input partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkflow.functions.links import (
    PAGE_SUFFIX, base_name, html_links, regex_links, strip_suffix,
)
from linkflow.plans.joins import split_join

# Adjacency rows hold at most about this many distinct neighbours each.
ADJACENCY_CHUNK = 10_000


# --- edges ------------------------------------------------------------------

def links_from_lines(lines: DataFrame, file_col: str = "file_name",
                     text_col: str = "line") -> DataFrame:
    """Line pattern over ``(file, line)`` rows -> one ``(source, target)`` per match.

    ``target`` keeps its ``.html``; ``source`` is the file name as given.
    """
    return lines.select(
        F.col(file_col).alias("source"),
        F.explode(regex_links(F.col(text_col))).alias("target"))


def links_from_documents(docs: DataFrame, name_col: str = "file_name",
                         content_col: str = "content",
                         suffix: str | None = PAGE_SUFFIX) -> DataFrame:
    """HTML links of whole documents -> ``(source, target)`` page ids.

    ``source`` is the base file name without its ``.html``. With ``suffix``
    set, only links ending in it are kept and it is removed from the targets;
    with ``suffix=None`` every non-empty ``href`` is kept as written.
    """
    name = base_name(F.col(name_col))
    source = F.when(name.endswith(PAGE_SUFFIX), strip_suffix(name, PAGE_SUFFIX)).otherwise(name)
    edges = docs.select(source.alias("source"),
                        F.explode(html_links(F.col(content_col))).alias("target"))
    if suffix is None:
        return edges
    return edges.where(F.col("target").endswith(suffix)).select(
        "source", strip_suffix(F.col("target"), suffix).alias("target"))


# --- counts -----------------------------------------------------------------

def inlink_occurrences(links: DataFrame) -> DataFrame:
    """Links into each target, duplicates counted: ``(target, occurrences)``."""
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("occurrences"))


def inlink_distinct(links: DataFrame) -> DataFrame:
    """Distinct linking sources per target: ``(target, sources)``.

    Planned as two aggregates: first by ``(target, source)``, which spreads a
    hub target over many tasks, then by ``target`` on the reduced rows.
    """
    return links.groupBy("target").agg(F.countDistinct("source").alias("sources"))


def inlink_counts(links: DataFrame) -> DataFrame:
    """Both counts in one pass: ``(target, occurrences, sources)``."""
    pairs = links.groupBy("target", "source").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("target").agg(F.sum("_n").alias("occurrences"),
                                       F.count(F.lit(1)).alias("sources"))


def in_degree(links: DataFrame) -> DataFrame:
    """In-degree of every page with at least one in-link: ``(page, in_degree)``."""
    return links.groupBy(F.col("target").alias("page")).agg(
        F.count(F.lit(1)).alias("in_degree"))


def out_degree(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Out-degree of every crawled page, zeros included: ``(page, out_degree)``.

    ``pages`` is the crawled set (one row per page, column ``page``); without
    it the crawled set is the distinct sources, so no page has zero links.
    Links are counted per source first; the join is then one row per side.
    """
    counts = links.groupBy(F.col("source").alias("page")).agg(
        F.count(F.lit(1)).alias("out_degree"))
    if pages is None:
        return counts
    return pages.select("page").join(counts, "page", "left").select(
        "page", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


# --- adjacency --------------------------------------------------------------

def _md5_bucket(value: Column, buckets: Column) -> Column:
    """Stable bucket in ``[0, buckets)`` from the first 32 bits of ``md5(value)``."""
    head = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, buckets)


def adjacency(links: DataFrame, pages: DataFrame | None = None,
              chunk_size: int = ADJACENCY_CHUNK) -> DataFrame:
    """Out- and in-lists per page, duplicates kept as counts.

    Rows ``(page, direction, chunk, neighbours)`` with ``direction`` in
    ``out``/``in`` and ``neighbours`` a sorted ``array<struct<page, links>>``.
    A page whose list has more than ``chunk_size`` distinct neighbours is split
    over ``ceil(n / chunk_size)`` rows by a hash of the neighbour, so no row or
    task has to hold the whole list of a hub page. With ``pages`` (column
    ``page``), a page of it without a list has a row with an empty one for
    each direction.
    """
    end = lambda page, direction, nb: F.struct(
        F.col(page).alias("page"), F.lit(direction).alias("direction"), F.col(nb).alias("nb"))
    # One scan of the links gives both directions.
    both = links.select(F.explode(F.array(
        end("source", "out", "target"), end("target", "in", "source"))).alias("e")).select("e.*")
    # Written once: the list widths and the lists both read it, instead of
    # aggregating the edges twice.
    pairs = both.groupBy("page", "direction", "nb").agg(
        F.count(F.lit(1)).alias("links")).checkpoint()
    # One non-null join key per (page, direction), NULL pages included.
    list_key = F.concat(F.col("direction"), F.when(F.col("page").isNull(), F.lit("0"))
                        .otherwise(F.concat(F.lit("1"), F.col("page"))))
    keyed = pairs.withColumn("_list", list_key)
    width = keyed.groupBy("_list").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(chunk_size)).cast("bigint").alias("_chunks"))
    # A hub page's pairs must not meet its width row in one task.
    chunked = split_join(keyed, width, "_list", "inner").withColumn(
        "chunk", _md5_bucket(F.col("nb"), F.col("_chunks")))
    lists = chunked.groupBy("page", "direction", "chunk").agg(
        F.sort_array(F.collect_list(F.struct(F.col("nb").alias("page"), "links")))
        .alias("neighbours"))
    if pages is None:
        return lists
    every = pages.select("page").distinct().select(
        "page", F.explode(F.array(F.lit("out"), F.lit("in"))).alias("direction"))
    listed = pairs.select("page", "direction").distinct()
    alone = every.join(listed, ["page", "direction"], "left_anti")
    empty = F.array().cast(lists.schema["neighbours"].dataType)
    return lists.unionByName(alone.select(
        "page", "direction", F.lit(0).cast("bigint").alias("chunk"), empty.alias("neighbours")))


def link_graph(links: DataFrame, pages: DataFrame | None = None,
               chunk_size: int = ADJACENCY_CHUNK) -> DataFrame:
    """Both lists of each page side by side: ``(page, chunk, outgoing, incoming)``.

    The merge of the out-lists and the in-lists, as a full outer join would
    give it, with NULL pages kept: a side that a page (or a chunk of it) lacks is
    an empty list, so every page of ``pages`` and every endpoint has a row. It is an
    aggregate by (page, chunk) over lists of at most about ``chunk_size``
    neighbours: a hub's chunks are merged in different tasks.
    """
    lists = adjacency(links, pages, chunk_size)
    empty = F.array().cast(lists.schema["neighbours"].dataType)
    side = lambda d: F.coalesce(F.first(F.when(F.col("direction") == d, F.col("neighbours")), ignorenulls=True), empty)
    return lists.groupBy("page", "chunk").agg(side("out").alias("outgoing"), side("in").alias("incoming"))


def render_neighbours(neighbours: Column) -> Column:
    """``'a*2,b*1'`` text form of a neighbour list (for reports and checks)."""
    return F.array_join(F.transform(
        neighbours, lambda x: F.concat(x["page"], F.lit("*"), x["links"].cast("string"))), ",")


# --- top lists --------------------------------------------------------------

def top_k(df: DataFrame, value: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` rows with the largest ``value`` (ties by ``key``), numbered.

    ``orderBy + limit`` plans as a bounded top-k per partition
    (TakeOrderedAndProject); the numbering window then sees ``k`` rows only.
    """
    top = df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)
    order = Window.orderBy(F.col(value).desc(), F.col(key).asc())
    return top.withColumn("position", F.row_number().over(order))
