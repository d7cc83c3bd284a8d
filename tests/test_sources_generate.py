"""File corpus readers, line splitting, requests table, generators."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from linkflow.operators import generate as G
from linkflow.operators import linkgraph as lg
from linkflow.sources import corpus as C
from linkflow.sources.sinks import write_batch, write_report, write_table


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_read_corpus_whole_and_lines(spark, tmp_dir):
    _write(tmp_dir, "1.html", '<a HREF="2.html"> x </a>\n<p>\n')
    _write(tmp_dir, "2.html", "no links\r\nsecond line")
    _write(tmp_dir, "notes.txt", '<a HREF="1.html">')
    whole = {r.file_name: r.content for r in C.read_corpus(spark, tmp_dir).collect()}
    assert set(whole) == {"1.html", "2.html"}           # glob keeps only *.html
    lines = C.read_corpus_lines(spark, tmp_dir)
    per_file = {}
    for r in lines.collect():
        per_file.setdefault(os.path.basename(r.file_path), []).append(r.line)
    # The table form of the same corpus splits lines exactly as the text reader.
    table = spark.createDataFrame(list(whole.items()), "file_name STRING, content STRING")
    split = {}
    for r in C.lines_of(table).orderBy("file_name", "line_no").collect():
        split.setdefault(r.file_name, []).append(r.line)
    assert split == per_file
    edges = lg.links_from_lines(lines.withColumnRenamed("file_path", "file_name"))
    assert [r.target for r in edges.collect()] == ["2.html"]


def test_missing_corpus_is_an_error_unless_allowed(spark, tmp_dir):
    absent = os.path.join(tmp_dir, "absent")
    for read in (C.read_corpus, C.read_corpus_lines):
        with pytest.raises(AnalysisException):
            read(spark, absent).count()
        assert read(spark, absent, missing_ok=True).count() == 0


def test_other_errors_are_not_an_empty_corpus(spark, tmp_dir):
    with pytest.raises(Exception):
        C.read_corpus(spark, "nosuchscheme://x/y", missing_ok=True).count()


def test_written_corpus_is_read_back(spark, tmp_dir):
    """Names that need escaping, texts of several lines, blank ones, line ends kept."""
    rows = [("1.html", "a\nb\r\nc"), ("2.html", ""), ("3.html", "ends\n"), ("a=b%c d.html", "é"), ("skip.txt", "x"), (None, "x"), ("4.html", None)]
    path = C.write_corpus(spark.createDataFrame(rows, "file_name STRING, content STRING"), os.path.join(tmp_dir, "c"))
    want = {n: t for n, t in rows if n and t is not None and n.endswith(".html")}
    assert {r.file_name: r.content for r in C.read_corpus(spark, path).collect()} == want
    lines = C.read_corpus_lines(spark, path, names=True).where("file_name = '1.html'").collect()
    assert [r.line for r in lines] == ["a", "b", "c"]
    assert {r.file_name: r.length for r in C.list_corpus(spark, path).collect()}["1.html"] == 7


def test_small_files_are_packed(spark, tmp_dir):
    """500 small files take as few tasks as their bytes need, and listing reads no content."""
    for i in range(500):
        with open(os.path.join(tmp_dir, f"{i}.html"), "w") as f:
            f.write(f"page {i}")
    corpus = C.read_corpus(spark, tmp_dir)
    assert corpus.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and corpus.count() == 500
    plan = C.list_corpus(spark, tmp_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema"):], plan


def test_bad_files_are_reported_by_their_first_reason(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "sub"))
    for name, data in {"1.html": b"good", "2.html": b" \n\t", "3.html": b"caf\xe9", "4.html": b"x" * 200, "sub/1.html": b"good too", "sub/2.html": b"\n", "6.html": b"", "5.txt": b"\xff"}.items():
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    got = {r.file_path.split(os.path.basename(tmp_dir) + "/")[-1]: r.reason for r in C.bad_files(spark, tmp_dir, recursive=True, large=100).collect()}
    assert got == {"2.html": "empty", "3.html": "not_utf8", "4.html": "too_large", "sub/1.html": "repeated_name", "sub/2.html": "empty"}


def test_report_is_ordered_over_its_files(spark, tmp_dir):
    df = spark.range(25_000, numPartitions=7).selectExpr("25000 - id AS n", "md5(cast(id AS string)) AS text")
    path = write_report(df, os.path.join(tmp_dir, "r"), ["n"], rows_per_file=4000)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    rows = [json.loads(line)["n"] for f in files for line in open(os.path.join(path, f))]
    assert rows == [*range(1, 25_001)] and len(files) > 6


def test_first_n_in_name_order(spark):
    df = spark.createDataFrame([(f"{i}.html", "") for i in [5, 1, 3, 10]], "file_name STRING, content STRING")
    assert [r.file_name for r in C.first_n(df, 2).collect()] == ["1.html", "10.html"]


def test_requests_table_round_trip_and_replay(spark, tmp_dir):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "request_id BIGINT, country STRING")
    path = os.path.join(tmp_dir, "t")
    write_table(rows, path)
    assert C.read_requests(spark, path, ["request_id", "country"]).count() == 2
    batch_path = os.path.join(tmp_dir, "b")
    write_batch(rows, batch_path, 7)
    write_batch(rows, batch_path, 7)                       # a replayed batch
    write_batch(rows.limit(1), batch_path, 8)
    assert spark.read.parquet(batch_path).count() == 3


def test_generated_corpus_links_parse_back(spark):
    ids = spark.range(40)
    corpus = G.web_corpus(ids, num_files=40, max_refs=12, seed=3).cache()
    n_links = ids.select(G.draw(F.col("id"), 3, "n", 12).alias("n")).agg(F.sum("n")).first()[0]
    edges = lg.links_from_lines(C.lines_of(corpus))
    assert edges.count() == n_links
    docs = lg.links_from_documents(corpus)
    assert docs.count() == n_links
    assert docs.where(~F.col("target").cast("int").between(0, 39)).count() == 0
    first = corpus.orderBy("file_name").first()
    assert first.content.startswith(G.PAGE_HEADER) and first.content.endswith(G.PAGE_FOOTER)


def test_cidr_book_unique_and_sized(spark):
    book = G.cidr_book(spark, seed=0).cache()
    assert book.select("cidr").distinct().count() == book.count()
    per = book.groupBy("country_idx").count().collect()
    assert len(per) == len(G.COUNTRIES)
    assert all(1 <= r["count"] <= 9 for r in per)


def test_generated_requests_domains(spark):
    ids = spark.range(3000).select("id", F.lit("2024-03-01").cast("date").alias("day"))
    reqs = G.requests(ids, index=50, seed=1, bucket="none", directory="files_get").cache()
    assert reqs.count() == 3000
    assert reqs.where(~F.col("x_country").isin(G.COUNTRIES)).count() == 0
    assert reqs.where(~F.col("x_age").isin(G.AGES)).count() == 0
    assert reqs.where(~F.col("path").rlike(r"^/files_get/[0-9]+\.html$")).count() == 0
    octets = reqs.select(F.split("x_client_ip", r"\.").alias("o"))
    assert octets.where(F.size("o") != 4).count() == 0
    hours = {r.h for r in reqs.select(F.hour("x_time").alias("h")).distinct().collect()}
    assert hours <= set(range(24)) and len(hours) == 24


def test_scale_conf_sizes_partitions_from_input():
    from linkflow.session import scale_conf
    conf = scale_conf(100 * 1024 ** 4)                      # 100 TB
    assert int(conf["spark.sql.shuffle.partitions"]) == 800 * 1024
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(scale_conf(1024)["spark.sql.shuffle.partitions"]) == 200   # floor for small inputs


def test_written_documents_are_files_in_few_folders(spark, tmp_dir):
    """No folder a document; a name's texts share a file; a second write replaces the first."""
    names = [f"{i}.html" for i in range(200)] + ["_x/y.html", ".html", "a=b%c +d.html", "7.html"]
    docs = spark.createDataFrame([(n, f"text of {n}") for n in names], "file_name STRING, content STRING")
    C.write_corpus(docs.limit(5).selectExpr("concat('old', file_name) AS file_name", "content"), os.path.join(tmp_dir, "c"))
    path = C.write_corpus(docs, os.path.join(tmp_dir, "c"))
    assert sum(len(folders) for _, folders, _ in os.walk(os.path.join(tmp_dir, "c"))) <= 8
    want = {n: f"text of {n}" for n in names} | {"7.html": "text of 7.html\ntext of 7.html"}
    assert {r.file_name: r.content for r in C.read_corpus(spark, path).collect()} == want
    assert {r.file_name for r in C.list_corpus(spark, path).collect()} == set(names)
    assert C.read_corpus_lines(spark, path, names=True).count() == len(names)
    assert {r.file_name for r in C.bad_files(spark, path, large=20).collect()} == {n for n, t in want.items() if len(t) > 19}
