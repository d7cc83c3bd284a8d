"""Streaming queries: each runs to the end of its input (availableNow), and the
registered callable returns the sink table read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkflow.functions import requests as R
from linkflow.plans.catalog import register
from linkflow.plans.q_requests import FACT_REQUESTS_SQL, dec_sql
from linkflow.session import scratch_path
from linkflow.sources import tables as T
from linkflow.sources.sinks import read_log_records
from linkflow.streaming import requests_stream as S
from linkflow.streaming.subscriber import decoded_writer, receive


def _requests(spark, sf_dir):
    schema = T.table(spark, sf_dir, "events").schema
    return S.request_stream(spark, sf_dir, schema)


def _with_dec(body: str, strict: bool = False) -> str:
    return T.with_views(body, "requests_raw", "files", ctes=[("dec", dec_sql(strict))])


@register("stream_decision", _with_dec(
    """SELECT request_id, method, file_name, country, status,
              CASE status WHEN 501 THEN 'Not Implemented' WHEN 400 THEN 'Permission Denied'
                   WHEN 404 THEN 'No such object: ' || file_name ELSE 'OK' END AS reason
       FROM dec"""))
def stream_decision(spark, sf_dir):
    base = scratch_path(spark, "stream-decision")
    S.wait(S.decision_stream(_requests(spark, sf_dir), T.files(spark, sf_dir),
                             f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@register("stream_facts", FACT_REQUESTS_SQL)
def stream_facts(spark, sf_dir):
    base = scratch_path(spark, "stream-facts")
    S.wait(S.facts_stream(_requests(spark, sf_dir), T.files(spark, sf_dir),
                          f"{base}/requests", f"{base}/failed_requests", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/requests").drop("batch_id")


def _fan_out(spark, sf_dir):
    base = scratch_path(spark, "stream-fan-out")
    S.wait(S.facts_stream(_requests(spark, sf_dir), T.files(spark, sf_dir), f"{base}/requests",
                          f"{base}/failed_requests", f"{base}/checkpoint", topic_path=f"{base}/topic", log_path=f"{base}/log"))
    return base


@register("stream_failed_requests", _with_dec(
    "SELECT request_id AS failed_request_id, file_name, CAST(status AS VARCHAR) AS error_code "
    "FROM dec WHERE status <> 200", strict=True))
def stream_failed_requests(spark, sf_dir):
    """The written failed_requests table (its server time is left out)."""
    failed = spark.read.parquet(f"{_fan_out(spark, sf_dir)}/failed_requests")
    return failed.select("failed_request_id", "file_name", "error_code")


@register("stream_topic", _with_dec(
    "SELECT request_id, country FROM dec WHERE status = 400", strict=True))
def stream_topic(spark, sf_dir):
    """The topic's messages, written by the same batches as both fact tables."""
    topic = spark.read.parquet(f"{_fan_out(spark, sf_dir)}/topic")
    return topic.select("request_id", R.from_utf8(F.col("value")).alias("country"))


@register("stream_log", _with_dec(
    """SELECT request_id, CASE WHEN status IN (501, 400) THEN 'ERROR' ELSE 'WARNING' END AS severity, status
       FROM dec WHERE status <> 200""", strict=True))
def stream_log(spark, sf_dir):
    """The log records of the fan-out, read back by severity."""
    log = f"{_fan_out(spark, sf_dir)}/log"
    return read_log_records(spark, log).select("request_id", "severity", "status")


@register("subscribe_redelivered", _with_dec("SELECT request_id, country FROM dec WHERE status = 400"))
def subscribe_redelivered(spark, sf_dir):
    """A subscriber whose first delivery fails after it has written: the batch
    is delivered again and replaces its rows."""
    base = scratch_path(spark, "stream-subscriber")
    S.wait(S.publish_banned(_requests(spark, sf_dir), T.files(spark, sf_dir),
                            f"{base}/topic", f"{base}/publisher"))
    write, failures = decoded_writer(f"{base}/received", f"{base}/dead"), [True]

    def fails_once(batch, batch_id):
        write(batch, batch_id)
        if failures:
            failures.pop()
            raise ConnectionError("the first delivery is not acknowledged")

    receive(spark, f"{base}/topic", fails_once, f"{base}/subscriber", available_now=True)
    return spark.read.parquet(f"{base}/received").drop("batch_id")


@register("stream_banned", _with_dec("SELECT request_id, country FROM dec WHERE status = 400"))
def stream_banned(spark, sf_dir):
    base = scratch_path(spark, "stream-topic")
    S.wait(S.publish_banned(_requests(spark, sf_dir), T.files(spark, sf_dir),
                            f"{base}/topic", f"{base}/publisher"))
    S.wait(S.subscribe_banned(spark, f"{base}/topic", f"{base}/received",
                              f"{base}/subscriber"))
    return spark.read.parquet(f"{base}/received")


@register("stream_vm_counts", T.with_views(
    "SELECT coalesce(vm_name, 'Unknown') AS vm_name, count(*) AS responses "
    "FROM requests_raw GROUP BY 1", "requests_raw"))
def stream_vm_counts(spark, sf_dir):
    base = scratch_path(spark, "stream-vm")
    S.wait(S.vm_counts_stream(_requests(spark, sf_dir), f"{base}/counts", f"{base}/checkpoint"))
    return S.latest_snapshot(spark, f"{base}/counts")
