"""Request handling as Structured Streaming queries.

* :func:`decision_stream` - requests judged as they arrive, inside
  ``foreachBatch``: a batch joins the newest version of the written corpus listing
  under AQE, so a file that many requests ask for is split, and a new
  version is seen without a restart. Each batch is written to partition
  ``batch_id=<id>`` with dynamic overwrite, so a replayed batch replaces its rows.
* :func:`facts_stream` - one query fans each micro-batch out to the
  ``requests`` and ``failed_requests`` tables and, if given, the topic and the
  log. The judged batch is persisted once.
* :func:`publish_banned` / :func:`subscribe_banned` - the topic: banned
  countries as UTF-8 bytes in an append-only file sink; the subscriber reads
  only committed topic files and decodes them. :mod:`linkflow.streaming.subscriber`
  has the subscriber with time-outs, acknowledgement and redelivery.
* :func:`vm_counts_stream` - running responses per VM (``complete`` mode);
  each trigger writes a snapshot of its own, partition ``batch_id=<id>``, which
  appears when its job commits; :func:`latest_snapshot` reads the newest.

Sources and the topic are file streams: no Kafka connector is available here,
so a Kafka source or sink is neither built nor tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkflow.functions import requests as R
from linkflow.operators import decision as D
from linkflow.sources.sinks import write_batch, write_log_batch
from linkflow.sources.tables import VIEWS
from linkflow.streaming.listing import Listing, listing_of
from linkflow.streaming.subscriber import TOPIC_SCHEMA


def table_stream(spark: SparkSession, folder: str, table: str, schema,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the Parquet files ``<table>.parquet`` / ``<table>*`` in ``folder``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def request_stream(spark: SparkSession, folder: str, events_schema,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Request rows from a stream of event files (the ``requests_raw`` view)."""
    _, exprs = VIEWS["requests_raw"]
    return table_stream(spark, folder, "events", events_schema,
                        max_files_per_trigger).selectExpr(*exprs)


def _start(writer, checkpoint: str, available_now: bool, path: str | None = None):
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="5 seconds")
    return writer.start(path) if path else writer.start()


def wait(query: StreamingQuery, timeout: float | None = None) -> StreamingQuery:
    """Block until the query ends (or ``timeout`` seconds, then stop it)."""
    finished = query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if timeout and not finished:
        query.stop()
    return query


def judged_batch(batch: DataFrame, listing: Listing, missing_country: str = "allow") -> DataFrame:
    """The decisions of one micro-batch. Streams run with AQE off; a batch
    here holds no state between batches, so its join is planned adaptively."""
    spark = batch.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # of the query's own session
    return D.decide(batch, listing.current(spark), missing_country=missing_country, listed=True)


def decision_stream(requests: DataFrame, corpus_names: DataFrame | Listing, out_path: str,
                    checkpoint: str, missing_country: str = "allow",
                    available_now: bool = True) -> StreamingQuery:
    listing = listing_of(corpus_names, f"{checkpoint.rstrip('/')}-listing")

    def write_decisions(batch: DataFrame, batch_id: int) -> None:
        write_batch(D.decision_view(judged_batch(batch, listing, missing_country)), out_path, batch_id)

    return _start(requests.writeStream.foreachBatch(write_decisions), checkpoint, available_now)


def facts_stream(requests: DataFrame, corpus_names: DataFrame | Listing, requests_path: str,
                 failed_path: str, checkpoint: str, missing_country: str = "not_found",
                 available_now: bool = True, topic_path: str | None = None,
                 log_path: str | None = None) -> StreamingQuery:
    listing = listing_of(corpus_names, f"{checkpoint.rstrip('/')}-listing")

    def write_facts(batch: DataFrame, batch_id: int) -> None:
        decided = judged_batch(batch, listing, missing_country).persist()
        try:
            write_batch(D.fact_requests(decided), requests_path, batch_id)
            write_batch(D.fact_failed_requests(decided), failed_path, batch_id)
            if topic_path:
                write_batch(D.banned_messages(decided), topic_path, batch_id)
            if log_path:
                write_log_batch(D.log_records(decided), log_path, batch_id)
        finally:
            decided.unpersist()

    return _start(requests.writeStream.foreachBatch(write_facts), checkpoint, available_now)


def publish_banned(requests: DataFrame, corpus_names: DataFrame | Listing, topic_path: str,
                   checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The topic is a file sink, so each message appears once; the listing's
    version is that of the query's start (the ban list needs no file lookup)."""
    listing = listing_of(corpus_names, f"{checkpoint.rstrip('/')}-listing")
    names = listing.current(requests.sparkSession)
    messages = D.banned_messages(D.decide(requests, names, listed=True))
    writer = messages.writeStream.format("parquet").outputMode("append")
    return _start(writer, checkpoint, available_now, topic_path)


def subscribe_banned(spark: SparkSession, topic_path: str, out_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    received = (spark.readStream.schema(TOPIC_SCHEMA).parquet(topic_path)
                .select("request_id", R.from_utf8(F.col("value")).alias("country")))
    writer = received.writeStream.format("parquet").outputMode("append")
    return _start(writer, checkpoint, available_now, out_path)


def vm_counts_stream(requests: DataFrame, out_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    counts = D.responses_by_vm(requests)

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out_path, batch_id)

    writer = counts.writeStream.outputMode("complete").foreachBatch(snapshot)
    return _start(writer, checkpoint, available_now)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed snapshot under ``path``."""
    snapshots = spark.read.parquet(path)
    newest = snapshots.agg(F.max("batch_id")).first()[0]
    return snapshots.where(F.col("batch_id") == newest).drop("batch_id")
