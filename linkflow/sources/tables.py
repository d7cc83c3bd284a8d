"""Driver tables and the four views derived from them.

The driver data holds neither `.html` links nor a request log, so the link and
request jobs read views computed from ``lineitem``, ``pages`` and ``events``.
Each view is one projection whose expressions are plain SQL, so the same text
runs in Spark (``selectExpr``) and, inlined as a CTE, in the DuckDB oracle.
Only the referenced columns reach the Parquet scan (column pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (Parquet; Catalyst prunes columns)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# View definitions: (base table, [select expressions]).
VIEWS: dict[str, tuple[str, list[str]]] = {
    # An order links to the parts of its lines; nodes grow with the tables.
    "links": ("lineitem", [
        "CAST(l_orderkey AS STRING) AS source",
        "CAST(l_partkey AS STRING) AS target",
    ]),
    # One anchor per line; some `href` lower case and some `.htm`.
    "html_lines": ("lineitem", [
        "CAST(l_orderkey AS STRING) || '.html' AS file_name",
        "l_orderkey * 10 + l_linenumber AS line_no",
        """CASE WHEN l_returnflag = 'N' THEN '<a class="x" HREF="'
                WHEN l_linenumber = 1 THEN '<a href="'
                ELSE '<a HREF="' END
           || CAST(l_partkey AS STRING)
           || CASE WHEN l_suppkey % 10 = 0 THEN '.htm' ELSE '.html' END
           || '"> This is a link </a>' AS line""",
    ]),
    # The crawled corpus: one HTML document per page.
    "files": ("pages", [
        "CAST(page_id AS STRING) || '.html' AS file_name",
        "html AS content",
    ]),
    # One request per event, headers as nullable strings.
    "requests_raw": ("events", [
        "event_id AS request_id",
        "CASE WHEN event_type = 'error' THEN 'POST' ELSE 'GET' END AS method",
        "'/files_get/' || CAST(user_id * 4 AS STRING) || '.html' AS path",
        """CASE user_id % 12 WHEN 0 THEN 'Iran' WHEN 1 THEN ' North Korea ' WHEN 2 THEN 'CUBA'
             WHEN 3 THEN 'South Sudan' WHEN 4 THEN 'Sudan' WHEN 5 THEN NULL WHEN 6 THEN 'France'
             WHEN 7 THEN 'Congo, Republic of the'
             ELSE 'Country ' || CAST(user_id % 30 AS STRING) END AS x_country""",
        """CAST(CAST(FLOOR(FLOOR(((user_id * 104729 + 7919) % 16000000) / 255.0) / 255.0) AS INT) AS STRING) || '.' ||
           CAST(CAST(FLOOR(((user_id * 104729 + 7919) % 16000000) / 255.0) AS INT) % 255 AS STRING) || '.' ||
           CAST(((user_id * 104729 + 7919) % 16000000) % 255 AS STRING) || '.' ||
           CAST(event_id % 255 AS STRING) AS x_client_ip""",
        "CASE WHEN event_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS x_gender",
        """CASE event_id % 8 WHEN 0 THEN '0-16' WHEN 1 THEN '17-25' WHEN 2 THEN '26-35'
             WHEN 3 THEN '36-45' WHEN 4 THEN '46-55' WHEN 5 THEN '56-65' WHEN 6 THEN '66-75'
             ELSE '76+' END AS x_age""",
        """CASE (event_id * 3 + user_id) % 8 WHEN 0 THEN '0-10k' WHEN 1 THEN '10k-20k'
             WHEN 2 THEN '20k-40k' WHEN 3 THEN '40k-60k' WHEN 4 THEN '60k-100k'
             WHEN 5 THEN '100k-150k' WHEN 6 THEN '150k-250k' ELSE '250k+' END AS x_income""",
        "date_trunc('hour', ts) AS x_time",
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'www1' WHEN 2 THEN 'www1' ELSE 'www2' END AS vm_name",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "links")


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "html_lines")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files")


def requests_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "requests_raw")


def view_sql(name: str) -> str:
    """The view as SQL text over the driver table (for oracle CTEs)."""
    base, exprs = VIEWS[name]
    return "SELECT " + ",\n       ".join(exprs) + f"\nFROM {base}"


def with_views(body: str, *names: str, ctes: list[tuple[str, str]] = ()) -> str:
    """Prefix ``body`` with CTEs for the named views, then the extra ``ctes``."""
    parts = [f"{n} AS (\n{view_sql(n)}\n)" for n in names]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in ctes]
    return f"WITH {',\n'.join(parts)}\n{body}" if parts else body
