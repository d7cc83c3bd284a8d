"""Corpus sources: whole HTML files, lines with their file, the requests table.

* :func:`write_corpus` - documents as a folder of files, one a document.
* :func:`list_corpus` - the files' names, sizes and times, no content read.
* :func:`read_corpus` - one row per file ``(file_name, content)``, the text read
  whole; only names that end in ``.html`` are listed, so other objects are pruned
  at listing time, not after reading. Many small files are packed into one task.
* :func:`read_corpus_lines` - one row per line ``(file_path, line)``.
* :func:`bad_files` - the files that a reader of whole texts has trouble with.
* :func:`corpus_from_table` / :func:`lines_of` - the same shapes from a table
  that already holds documents (the driver's ``pages``).
* :func:`first_n` - the first ``n`` files in name order.
* :func:`read_requests` - the ``requests`` table from JDBC (partitioned by id
  range), a Parquet path or a catalog table; only the asked-for columns.

Files of no bytes are passed over by Spark's file scans: neither listed nor read
(:func:`write_corpus` writes none). Three layouts are read: a folder of files (``dir/12.html``), what
:func:`write_corpus` writes (``dir/task=3/n12.html``: a folder a task, names escaped), and what Spark writes
when every document is a partition (``dir/file_name=12.html/part-...``).
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from linkflow.functions.links import PAGE_SUFFIX, base_name
from linkflow.sources import storage

REQUEST_COLUMNS = ["request_id", "gender", "age", "income", "time", "ip_address",
                   "file_name", "country", "is_banned"]
NAMED = "file_name="
TASK = "task="
# Bytes of files that one task reads; a whole text beyond LARGE is reported.
PACKED_BYTES = 128 << 20
LARGE = 64 << 20


def _escaped(name: str) -> str:
    """``name`` as part of a file's name: quoted with ``=`` for ``%``, which paths escape again."""
    return quote(name, safe="").replace("%", "=")


def _write_files(rows: Iterable[Row], path: str) -> None:
    """One task's documents, sorted by name, as files of a folder of the task's own."""
    store, top = fs.FileSystem.from_uri(path)
    folder = f"{top}/{TASK}{TaskContext.get().partitionId()}"
    store.create_dir(folder, recursive=True)
    for name, docs in groupby(rows, key=lambda r: r.file_name):
        with store.open_output_stream(f"{folder}/n{_escaped(name)}") as out:  # no name begins with '_' or '.'
            for doc in docs:
                out.write(doc.value.encode() + b"\n")


def write_corpus(docs: DataFrame, path: str, name_col: str = "file_name", content_col: str = "content") -> str:
    """Writes each document as a file of its own, ended by a line break (null
    names or texts are no documents). Documents are dealt out by name, so a file
    is written by one task, and a lost task writes the same files again. Texts
    of one name follow each other in one file.

    A folder a document, made and moved by Spark's committer, costs many calls of
    the store for each document; here it is one file, in a folder of its task.
    Arrow writes to local folders, HDFS, S3 and GCS. On a store that it lacks
    Spark writes a folder of each document's name."""
    spark, path = docs.sparkSession, storage.qualified(docs.sparkSession, path)
    named = docs.select(F.col(name_col).alias("file_name"), F.col(content_col).alias("value")).dropna()
    dealt = named.repartition("file_name")
    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):
        dealt.write.mode("overwrite").partitionBy("file_name").text(path)
        return path
    storage.delete(spark, path)
    dealt.sortWithinPartitions("file_name").foreachPartition(lambda rows: _write_files(rows, path))
    return path


def _reader(spark: SparkSession, path: str, suffix: str, recursive: bool):
    """(reader, what to load, the layout: NAMED, TASK or none)."""
    path = path.rstrip("/")
    children = storage.children(spark, path)
    if any(n.startswith(NAMED) for n in children):
        return spark.read.option("basePath", path), f"{path}/{NAMED}*{suffix}", NAMED
    if any(n.startswith(TASK) for n in children):
        return spark.read.option("pathGlobFilter", f"n*{_escaped(suffix)}").option("recursiveFileLookup", True), path, TASK
    return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive), path, ""


def _missing(spark: SparkSession, path: str, missing_ok: bool) -> bool:
    """Whether there is nothing to read and that is allowed. Every other
    trouble, and a missing path that is not allowed, is an error of the reader."""
    return missing_ok and not storage.exists(spark, path)


def _name(file_path: Column, layout: str) -> Column:
    if layout == TASK:
        return F.url_decode(F.replace(F.substr(base_name(file_path), F.lit(2)), F.lit("="), F.lit("%")))
    return F.col("file_name") if layout else base_name(file_path)


def list_corpus(spark: SparkSession, path: str, suffix: str = PAGE_SUFFIX, recursive: bool = False) -> DataFrame:
    """``(file_name, file_path, length, modified)`` of the files under ``path``."""
    reader, load, layout = _reader(spark, path, suffix, recursive)
    files = reader.format("binaryFile").load(load)
    return files.select(_name(F.col("path"), layout).alias("file_name"), F.col("path").alias("file_path"),
                        "length", F.col("modificationTime").alias("modified"))


def read_corpus(spark: SparkSession, path: str, suffix: str = PAGE_SUFFIX, recursive: bool = False,
                missing_ok: bool = False, packed_bytes: int = PACKED_BYTES) -> DataFrame:
    """Whole files under ``path`` as ``(file_name, content)``; the line break at
    the end of a file that :func:`write_corpus` wrote is not content.

    Files are packed into tasks of about ``packed_bytes``, whatever their
    number. A missing path is an error, or gives no rows with ``missing_ok``.
    """
    if _missing(spark, path, missing_ok):
        return spark.createDataFrame([], "file_name STRING, content STRING")
    reader, load, layout = _reader(spark, path, suffix, recursive)
    # text() has its own wholetext=False default, so the flag goes there.
    df = reader.text(load, wholetext=True)
    content = F.regexp_replace("value", r"\n\z", "") if layout else F.col("value")
    # The bytes that the listing of this very reader has found: no second one.
    total = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    # Spark counts each file's opening as 4 MB, so it would make a task of 32 small ones.
    return df.select(_name(F.col("_metadata.file_path"), layout).alias("file_name"),
                     content.alias("content")).coalesce(max(1, spark.sparkContext.defaultParallelism, -(-total // packed_bytes)))


def read_corpus_lines(spark: SparkSession, path: str, suffix: str = PAGE_SUFFIX,
                      recursive: bool = False, missing_ok: bool = False, names: bool = False) -> DataFrame:
    """Lines of the files under ``path`` as ``(file_path, line)``, the path as
    a full URI; with ``names`` also ``file_name``."""
    if _missing(spark, path, missing_ok):
        return spark.createDataFrame([], "file_path STRING" + ", file_name STRING" * names + ", line STRING")
    reader, load, layout = _reader(spark, path, suffix, recursive)
    path_col = F.col("_metadata.file_path")
    name = [_name(path_col, layout).alias("file_name")] if names else []
    return reader.text(load).select(path_col.alias("file_path"), *name, F.col("value").alias("line"))


def bad_files(spark: SparkSession, path: str, suffix: str = PAGE_SUFFIX, recursive: bool = False,
              large: int = LARGE) -> DataFrame:
    """``(file_name, file_path, reason)`` of the files that whole-text jobs
    should not take as they are, by the first reason that fits: ``too_large``
    (over ``large`` bytes; not read), ``empty`` (white space alone),
    ``not_utf8``, ``repeated_name`` (of several with a name, all but the first path)."""
    reader, load, layout = _reader(spark, path, suffix, recursive)
    files = reader.format("binaryFile").load(load)
    ident = [_name(F.col("path"), layout).alias("file_name"), F.col("path").alias("file_path")]
    over = files.where(F.col("length") > large).select(*ident, F.lit("too_large").alias("reason"))
    text = F.col("content").cast("string")
    reason = F.when(F.trim(F.translate(text, "\t\n\r", "   ")) == "", "empty").when(~F.is_valid_utf8(text), "not_utf8")
    read = files.where(F.col("length") <= large).select(*ident, reason.alias("reason")).where("reason IS NOT NULL")
    first = files.select(*ident).groupBy("file_name").agg(F.min("file_path").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = files.select(*ident).join(first, "file_name").where(F.col("file_path") > F.col("first")).select("file_name", "file_path", F.lit("repeated_name").alias("reason"))
    found = over.unionByName(read).unionByName(again)
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(("too_large", "empty", "not_utf8", "repeated_name")) for x in (r, k)))
    return found.groupBy("file_name", "file_path").agg(F.min_by("reason", rank[F.col("reason")]).alias("reason"))


def corpus_from_table(docs: DataFrame, name_col: str = "file_name",
                      content_col: str = "content", suffix: str = PAGE_SUFFIX) -> DataFrame:
    """Documents of a table whose name ends in ``suffix`` (case-sensitive)."""
    return docs.where(F.col(name_col).endswith(suffix)).select(
        F.col(name_col).alias("file_name"), F.col(content_col).alias("content"))


def lines_of(corpus: DataFrame) -> DataFrame:
    """Split documents into ``(file_name, line_no, line)`` as a text reader would:
    ``\\n``, ``\\r\\n`` and ``\\r`` end lines; a final line break opens no line;
    an empty document has no lines."""
    body = F.regexp_replace(F.col("content"), r"(\r\n|\r|\n)\z", "")
    return (corpus.where(F.length("content") > 0)
            .select("file_name", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("pos", "line"))
            .select("file_name", (F.col("pos") + 1).alias("line_no"), "line"))


def first_n(corpus: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` files in name order (a bounded top-k, not a full sort)."""
    return corpus.orderBy("file_name").limit(n)


def read_requests(spark: SparkSession, source: str, columns: list[str] | None = None,
                  jdbc: dict | None = None) -> DataFrame:
    """The ``requests`` table from ``source``.

    ``jdbc:...`` URLs are read in parallel slices of ``request_id``: pass
    ``jdbc={"lowerBound": .., "upperBound": .., "numPartitions": .., plus
    user/password/driver}``; credentials come from the caller, never the code.
    A path reads Parquet; any other string is a catalog table name.
    """
    columns = columns or REQUEST_COLUMNS
    if source.startswith("jdbc:"):
        opts = dict(jdbc or {})
        reader = spark.read.format("jdbc").option("url", source).option("dbtable", "requests")
        if {"lowerBound", "upperBound", "numPartitions"} <= opts.keys():
            reader = reader.option("partitionColumn", "request_id")
        for key, value in opts.items():
            reader = reader.option(key, str(value))
        df = reader.load()
    elif "/" in source:
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    return df.select(*columns)

