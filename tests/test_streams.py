"""Streams give the batch result, also when stopped and restarted."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from linkflow.operators import decision as D
from linkflow.sources import tables as T
from linkflow.sources.sinks import read_log_records, write_log_batch
from linkflow.streaming import requests_stream as S
from linkflow.streaming.listing import Listing
from linkflow.streaming.subscriber import decoded_writer, receive
from tests.conftest import SF_SMALL


def _split_events(spark, folder, parts=2):
    """Copy the driver's events into ``parts`` files named events-<i>.parquet."""
    ev = T.table(spark, SF_SMALL, "events")
    paths = []
    for i in range(parts):
        path = os.path.join(folder, f"stage-{i}")
        ev.where(F.pmod(F.col("event_id"), F.lit(parts)) == i).coalesce(1).write.parquet(path)
        paths.append(path)
    return ev.schema, paths


def _publish(path, folder, i):
    """Move one staged file into the watched folder (what an uploader does)."""
    src = [f for f in os.listdir(path) if f.endswith(".parquet")][0]
    os.link(os.path.join(path, src), os.path.join(folder, f"events-{i}.parquet"))


def test_decision_stream_equals_batch_after_restart(spark, tmp_dir):
    watched = os.path.join(tmp_dir, "in")
    os.makedirs(watched)
    schema, staged = _split_events(spark, tmp_dir)
    files = T.files(spark, SF_SMALL)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")

    _publish(staged[0], watched, 0)
    S.wait(S.decision_stream(S.request_stream(spark, watched, schema), files, out, ckpt))
    first = spark.read.parquet(out).count()
    _publish(staged[1], watched, 1)                       # new data, then a restart
    S.wait(S.decision_stream(S.request_stream(spark, watched, schema), files, out, ckpt))

    streamed = spark.read.parquet(out).drop("batch_id")
    batch = D.decision_view(D.decide(T.requests_raw(spark, SF_SMALL), files))
    assert 0 < first < streamed.count()
    assert streamed.count() == streamed.select("request_id").distinct().count()   # no duplicates
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_facts_stream_and_topic(spark, tmp_dir):
    watched = os.path.join(tmp_dir, "in")
    os.makedirs(watched)
    schema, staged = _split_events(spark, tmp_dir)
    files = T.files(spark, SF_SMALL)
    for i, path in enumerate(staged):
        _publish(path, watched, i)
    reqs = S.request_stream(spark, watched, schema, max_files_per_trigger=1)
    base = os.path.join(tmp_dir, "facts")
    S.wait(S.facts_stream(reqs, files, f"{base}/requests", f"{base}/failed", f"{base}/ckpt"))
    got_req = spark.read.parquet(f"{base}/requests")
    assert got_req.select("batch_id").distinct().count() == 2      # one partition per batch
    decided = D.decide(T.requests_raw(spark, SF_SMALL), files, missing_country="not_found")
    want_req = D.fact_requests(decided)
    assert got_req.drop("batch_id").exceptAll(want_req).count() == 0
    assert got_req.count() == want_req.count()
    assert spark.read.parquet(f"{base}/failed").count() == D.fact_failed_requests(decided).count()

    S.wait(S.publish_banned(S.request_stream(spark, watched, schema), files,
                            f"{base}/topic", f"{base}/pub"))
    S.wait(S.subscribe_banned(spark, f"{base}/topic", f"{base}/recv", f"{base}/sub"))
    S.wait(S.subscribe_banned(spark, f"{base}/topic", f"{base}/recv", f"{base}/sub"))  # re-run: nothing new
    received = spark.read.parquet(f"{base}/recv")
    banned = D.decide(T.requests_raw(spark, SF_SMALL), files).where("status = 400")
    assert received.count() == banned.count()
    assert received.select("country").distinct().exceptAll(
        banned.select("country").distinct()).count() == 0


def test_vm_counts_stream_matches_batch(spark, tmp_dir):
    watched = os.path.join(tmp_dir, "in")
    os.makedirs(watched)
    schema, staged = _split_events(spark, tmp_dir)
    for i, path in enumerate(staged):
        _publish(path, watched, i)
    out, ckpt = os.path.join(tmp_dir, "vm"), os.path.join(tmp_dir, "vmck")
    S.wait(S.vm_counts_stream(S.request_stream(spark, watched, schema, 1), out, ckpt))
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1   # a snapshot for each batch
    got = {r.vm_name: r.responses for r in S.latest_snapshot(spark, out).collect()}
    want = {r.vm_name: r.responses
            for r in D.responses_by_vm(T.requests_raw(spark, SF_SMALL)).collect()}
    assert got == want


# --- listing versions, skew, log, subscriber --------------------------------

REQUEST = "request_id BIGINT, method STRING, path STRING, x_country STRING, x_gender STRING, x_age STRING, x_income STRING, x_time TIMESTAMP, x_client_ip STRING"


def _raw(spark, ids, name):
    return spark.createDataFrame([(i, "GET", f"/b/{name(i)}.html", "France", "Male", "0-16", "0-10k", None, "1.2.3.4") for i in ids], REQUEST)


def test_a_new_listing_version_is_seen_without_a_restart(spark, tmp_dir):
    listing, watched = Listing(f"{tmp_dir}/listing"), f"{tmp_dir}/in"
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "file_name STRING")
    assert listing.publish(names("a.html", "a.html")) == 0
    _raw(spark, [1, 2], lambda i: "ab"[i - 1]).write.mode("append").parquet(watched)
    query = S.decision_stream(spark.readStream.schema(REQUEST).parquet(watched), listing, f"{tmp_dir}/out", f"{tmp_dir}/ck", available_now=False)
    try:
        query.processAllAvailable()
        assert listing.publish(names("b.html")) == 1
        _raw(spark, [3, 4], lambda i: "ab"[i - 3]).write.mode("append").parquet(watched)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.request_id: (r.status, r.batch_id) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {1: (200, 0), 2: (404, 0), 3: (404, 1), 4: (200, 1)}
    for _ in range(3):
        listing.publish(names("c.html"))
    assert listing.versions(spark) == [3, 4]


def test_a_batchs_lookup_splits_a_hot_file(spark, tmp_dir, monkeypatch):
    """A third of the requests ask for one file: the join in foreachBatch is skewed and split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.shuffle.partitions": "16"}
    plans = []

    def spy(df, path, batch_id):
        df.write.format("noop").mode("overwrite").save()
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert len(rows) == 30_000

    monkeypatch.setattr(S, "write_batch", spy)
    raw = spark.range(30_000, numPartitions=6).selectExpr("id AS request_id", "'GET' AS method", "concat('/b/', if(id % 3 = 0, 0, id), '.html') AS path", "'France' AS x_country",
                                                          "md5(cast(id AS string)) AS x_gender", "'0-16' AS x_age", "'x' AS x_income", "cast(null AS timestamp) AS x_time", "'1.2.3.4' AS x_client_ip")
    raw.write.parquet(f"{tmp_dir}/in")
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        names = spark.range(20_000).selectExpr("concat(id, '.html') AS file_name")
        S.wait(S.decision_stream(spark.readStream.schema(REQUEST).parquet(f"{tmp_dir}/in"), names, f"{tmp_dir}/out", f"{tmp_dir}/ck"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(plans) == 1 and "skew=true" in plans[0], plans


def test_log_batches_are_replaced_by_a_replay(spark, tmp_dir):
    records = lambda *r: spark.createDataFrame(r, "request_id BIGINT, severity STRING, status INT, message STRING")
    path = f"{tmp_dir}/log"
    write_log_batch(records((1, "ERROR", 400, "a"), (2, "WARNING", 404, "b")), path, 0)
    write_log_batch(records((3, "WARNING", 501, "c")), path, 1)
    write_log_batch(records((1, "WARNING", 404, "a"), (2, "WARNING", 404, "b")), path, 0)  # the replay has no ERROR
    got = sorted(map(tuple, read_log_records(spark, path).select("request_id", "severity", "batch_id").collect()))
    assert got == [(1, "WARNING", 0), (2, "WARNING", 0), (3, "WARNING", 1)]
    assert read_log_records(spark, path, "ERROR").count() == 0


def _topic(spark, path, rows):
    spark.createDataFrame(rows, "request_id BIGINT, value BINARY").coalesce(1).write.mode("append").parquet(path)


def test_subscriber_stops_when_idle_and_takes_what_comes_late(spark, tmp_dir):
    topic, got = f"{tmp_dir}/topic", []
    _topic(spark, topic, [(1, b"iran")])
    late = threading.Timer(1.0, lambda: _topic(spark, topic, [(2, b"cuba")]))
    late.start()
    began = time.monotonic()
    out = receive(spark, topic, lambda b, i: got.extend(r.request_id for r in b.collect()), f"{tmp_dir}/ck", idle=5.0, interval="200 milliseconds")
    late.join()
    assert out.ended == "idle" and sorted(got) == [1, 2] and out.delivered == out.acknowledged == [0, 1]
    assert time.monotonic() - began >= 5.5
    again = receive(spark, topic, lambda b, i: got.append("again"), f"{tmp_dir}/ck", listen=2.0)
    assert again.ended == "listen" and again.delivered == [] and "again" not in got  # acknowledged messages don't come back


def test_subscriber_redelivers_a_failed_batch_once(spark, tmp_dir):
    topic = f"{tmp_dir}/topic"
    _topic(spark, topic, [(1, b"iran"), (2, b"\xff\xfe"), (3, None)])
    write, left = decoded_writer(f"{tmp_dir}/out", f"{tmp_dir}/dead"), [1]

    def fails(batch, batch_id):
        write(batch, batch_id)
        if left:
            left.pop()
            raise OSError("lost")

    out = receive(spark, topic, fails, f"{tmp_dir}/ck", available_now=True)
    assert (out.delivered, out.acknowledged, out.redelivered, out.ended) == ([0, 0], [0], [0], "end")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/out").select("request_id", "country").collect()] == [(1, "iran")]
    assert sorted(r.request_id for r in spark.read.parquet(f"{tmp_dir}/dead").collect()) == [2, 3]


def test_a_batch_that_fails_twice_ends_the_subscription_unacknowledged(spark, tmp_dir):
    topic, seen = f"{tmp_dir}/topic", []
    _topic(spark, topic, [(1, b"iran")])

    def fails(batch, batch_id):
        seen.append(batch_id)
        raise OSError("lost")

    with pytest.raises(Exception):
        receive(spark, topic, fails, f"{tmp_dir}/ck", available_now=True)
    assert seen == [0, 0]
    out = receive(spark, topic, lambda b, i: seen.append("taken"), f"{tmp_dir}/ck", available_now=True)
    assert out.acknowledged == [0] and seen[-1] == "taken"


def test_a_subscription_needs_an_end(spark, tmp_dir):
    with pytest.raises(ValueError):
        receive(spark, f"{tmp_dir}/topic", lambda b, i: None, f"{tmp_dir}/ck")
