"""Source queries: corpus from the pages table, its lines, the requests table."""

from __future__ import annotations

from linkflow.operators import decision as D
from linkflow.plans.catalog import register
from linkflow.plans.q_requests import FACT_REQUESTS_SQL, PROCESSING_TIME  # noqa: F401
from linkflow.session import scratch_path
from linkflow.sources import corpus as C
from linkflow.sources import tables as T
from linkflow.sources.sinks import write_table

FIRST_N = 500


@register("src_corpus_whole", T.with_views(
    "SELECT file_name, content FROM files WHERE file_name LIKE '%.html'", "files"))
def src_corpus_whole(spark, sf_dir):
    return C.corpus_from_table(T.files(spark, sf_dir))


@register("src_corpus_lines", T.with_views(
    r"""SELECT file_name, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no,
       unnest(parts) AS line
FROM (SELECT file_name,
             string_split_regex(regexp_replace(content, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS parts
      FROM files WHERE file_name LIKE '%.html' AND length(content) > 0)""", "files"))
def src_corpus_lines(spark, sf_dir):
    return C.lines_of(C.corpus_from_table(T.files(spark, sf_dir)))


def _written_files(spark, sf_dir):
    return C.write_corpus(T.files(spark, sf_dir), scratch_path(spark, "corpus"))


@register("src_files_whole", T.with_views("SELECT file_name, content FROM files", "files"))
def src_files_whole(spark, sf_dir):
    """The corpus written as files to the shared folder and read whole."""
    return C.read_corpus(spark, _written_files(spark, sf_dir))


@register("src_files_lines", T.with_views(
    r"""SELECT file_name, unnest(string_split_regex(content, '\r\n|\r|\n')) AS line FROM files""", "files"))
def src_files_lines(spark, sf_dir):
    """The same files read line by line (a file ends in a line break of its own)."""
    return C.read_corpus_lines(spark, _written_files(spark, sf_dir), names=True).select("file_name", "line")


LARGE_PAGE = 2_000


@register("src_bad_files", T.with_views(
    f"""SELECT file_name, CASE WHEN strlen(content) + 1 > {LARGE_PAGE} THEN 'too_large' ELSE 'empty' END AS reason
        FROM (SELECT file_name, CASE WHEN length(file_name) % 2 = 0 THEN content ELSE chr(10) END AS content FROM files)
        WHERE strlen(content) + 1 > {LARGE_PAGE} OR trim(content, chr(10)) = ''""", "files"))
def src_bad_files(spark, sf_dir):
    """The report over the corpus files, of which some are blank and some over a bound."""
    docs = T.files(spark, sf_dir).selectExpr("file_name", "CASE WHEN length(file_name) % 2 = 0 THEN content ELSE '\n' END AS content")
    path = C.write_corpus(docs, scratch_path(spark, "corpus"))
    return C.bad_files(spark, path, large=LARGE_PAGE).select("file_name", "reason")


@register("pages_first_n", T.with_views(
    f"SELECT file_name, content FROM files WHERE file_name LIKE '%.html' "
    f"ORDER BY file_name LIMIT {FIRST_N}", "files"))
def pages_first_n(spark, sf_dir):
    return C.first_n(C.corpus_from_table(T.files(spark, sf_dir)), FIRST_N)


@register("src_requests", FACT_REQUESTS_SQL)
def src_requests(spark, sf_dir):
    """Fact rows appended to a Parquet table in the shared folder, read back."""
    decided = D.decide(T.requests_raw(spark, sf_dir), T.files(spark, sf_dir),
                       missing_country="not_found")
    path = write_table(D.fact_requests(decided), scratch_path(spark, "requests"))
    return C.read_requests(spark, path)
