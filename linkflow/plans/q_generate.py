"""Generator queries, driven by the driver tables' ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkflow.operators import generate as G
from linkflow.plans.catalog import register, sql_str
from linkflow.sources import tables as T

MAX_REFS = 250
SEED = 0
# The load client's notes use 10000 file indices under the files_get route.
REQUEST_INDEX = 10_000
REQUEST_DIR = "files_get"


def _h(key_sql: str) -> str:
    """DuckDB twin of generate.draw's hash: first 32 bits of md5(key)."""
    return f"CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT)"


def _key(id_sql: str, salt_sql: str) -> str:
    return f"CAST({id_sql} AS VARCHAR) || ':{SEED}:' || {salt_sql}"


GEN_WEB_CORPUS_SQL = f"""
SELECT CAST(id AS VARCHAR) || '.html' AS file_name,
       {sql_str(G.PAGE_HEADER)} ||
       array_to_string(list_transform(range({_h(_key('id', "'n'"))} % {MAX_REFS}),
           lambda j: {sql_str(G.PAGE_TEXT + G.LINK_OPEN)}
                     || CAST({_h(_key('id', 'CAST(j AS VARCHAR)'))} % nf.n AS VARCHAR)
                     || {sql_str(G.LINK_CLOSE)}), '')
       || {sql_str(G.PAGE_FOOTER)} AS content
FROM (SELECT page_id AS id FROM pages) ids, (SELECT count(*) AS n FROM pages) nf
"""


@register("gen_web_corpus", GEN_WEB_CORPUS_SQL)
def gen_web_corpus(spark, sf_dir):
    """One generated page per driver page id; link targets range over all of them."""
    pages = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return G.web_corpus(pages, num_files=pages.count(), max_refs=MAX_REFS, seed=SEED)


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


_K_LO, _K_HI = G.CIDRS_PER_COUNTRY
_C_LO, _C_HI = G.CIDR_RANGE
GEN_REQUESTS_SQL = f"""
WITH cands AS (
  SELECT country_idx, wanted, draw_no,
         {_h(_key('country_idx', "'cidr' || CAST(draw_no AS VARCHAR)"))} % {_C_HI - _C_LO} + {_C_LO} AS cidr
  FROM (SELECT country_idx, {_h(_key('country_idx', "'ncidr'"))} % {_K_HI - _K_LO} + {_K_LO} AS wanted
        FROM (SELECT unnest(range({len(G.COUNTRIES)})) AS country_idx)) c,
       LATERAL (SELECT unnest(range(c.wanted + {G.CIDR_SPARES})) AS draw_no)),
kept AS (SELECT * FROM cands
         QUALIFY row_number() OVER (PARTITION BY cidr ORDER BY country_idx, draw_no) = 1),
book AS (SELECT country_idx, slot, cidr FROM (
           SELECT *, row_number() OVER (PARTITION BY country_idx ORDER BY draw_no) - 1 AS slot
           FROM kept) WHERE slot < wanted),
slots AS (SELECT country_idx, count(*) AS n_cidrs FROM book GROUP BY country_idx),
base AS (SELECT event_id AS request_id, CAST(ts AS DATE) AS day,
                {_h(_key('event_id', "'country'"))} % {len(G.COUNTRIES)} AS country_idx
         FROM events),
picked AS (SELECT b.*, {_h(_key('b.request_id', "'cidr'"))} % s.n_cidrs AS slot
           FROM base b JOIN slots s ON b.country_idx = s.country_idx),
x AS (SELECT p.request_id, p.day, p.country_idx, k.cidr FROM picked p
      JOIN book k ON p.country_idx = k.country_idx AND p.slot = k.slot)
SELECT request_id,
       'GET' AS method,
       '/{REQUEST_DIR}/' || CAST({_h(_key('request_id', "'file'"))} % {REQUEST_INDEX} AS VARCHAR) || '.html' AS path,
       {_list_sql(G.COUNTRIES)}[country_idx + 1] AS x_country,
       CAST(cidr // 255 // 255 AS VARCHAR) || '.' || CAST((cidr // 255) % 255 AS VARCHAR) || '.' ||
         CAST(cidr % 255 AS VARCHAR) || '.' || CAST({_h(_key('request_id', "'octet4'"))} % 255 AS VARCHAR)
         AS x_client_ip,
       {_list_sql(G.GENDERS)}[{_h(_key('request_id', "'gender'"))} % {len(G.GENDERS)} + 1] AS x_gender,
       {_list_sql(G.AGES)}[{_h(_key('request_id', "'age'"))} % {len(G.AGES)} + 1] AS x_age,
       {_list_sql(G.INCOMES)}[{_h(_key('request_id', "'income'"))} % {len(G.INCOMES)} + 1] AS x_income,
       CAST(strftime(day, '%Y-%m-%d') || ' ' || lpad(CAST({_h(_key('request_id', "'hour'"))} % 24 AS VARCHAR), 2, '0')
            || ':00:00' AS TIMESTAMP) AS x_time
FROM x
"""


@register("gen_requests", GEN_REQUESTS_SQL)
def gen_requests(spark, sf_dir):
    """One generated request per driver event, made on the event's day."""
    ids = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    return G.requests(ids, index=REQUEST_INDEX, seed=SEED, directory=REQUEST_DIR)
