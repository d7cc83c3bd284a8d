"""Request decision, fact rows, messages and log records."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkflow.operators import decision as D
from linkflow.sources import tables as T
from tests.conftest import SF_MID

SCHEMA = ("request_id BIGINT, method STRING, path STRING, x_country STRING, x_client_ip STRING, "
          "x_gender STRING, x_age STRING, x_income STRING, x_time TIMESTAMP, vm_name STRING")
T0 = dt.datetime(2024, 1, 1, 5)


def _req(i, method, path, country):
    return (i, method, path, country, "1.2.3.4", "Male", "0-16", "0-10k", T0, "www1")


CASES = [
    _req(1, "POST", "/files_get/1.html", "Iran"),         # 501 before the country
    _req(2, "GET", "/files_get/1.html", None),            # 200 (404 when strict)
    _req(3, "GET", "/files_get/1.html", " Iran\t"),       # banned after strip
    _req(4, "GET", "/files_get/1.html", "South Sudan"),   # not banned
    _req(5, "GET", "/files_get/9.html", "France"),        # missing file
    _req(6, "GET", "/files_get/9.html", "SUDAN"),         # banned beats missing file
    _req(7, None, "/files_get/1.html", "France"),         # no method: not GET
]


@pytest.fixture
def reqs(spark):
    return spark.createDataFrame(CASES, SCHEMA)


@pytest.fixture
def names(spark):
    return spark.createDataFrame([("1.html", "<p>one</p>")], "file_name STRING, content STRING")


def test_decision_precedence(reqs, names):
    got = {r.request_id: r.status for r in D.decide(reqs, names).collect()}
    assert got == {1: 501, 2: 200, 3: 400, 4: 200, 5: 404, 6: 400, 7: 501}
    strict = {r.request_id: r.status for r in D.decide(reqs, names, missing_country="not_found").collect()}
    assert strict == {**got, 2: 404}


def test_health_branch(spark, names):
    df = spark.createDataFrame([_req(1, "GET", "/health", None)], SCHEMA)
    assert D.decide(df, names, health=True).first().status == 200
    both = D.decide(df.withColumn("vm_name", F.lit("www1")).unionByName(df.withColumn("vm_name", F.lit(None).cast("string"))), names, health=True)
    assert sorted(r.reason for r in both.collect()) == ["OK: Unknown", "OK: www1"]
    assert D.decide(df, names).first().status == 404


def test_fact_tables_route_rows(reqs, names):
    decided = D.decide(reqs, names, missing_country="not_found").cache()
    facts = {r.request_id: r.is_banned for r in D.fact_requests(decided).collect()}
    failed = {r.failed_request_id: r.error_code for r in D.fact_failed_requests(decided).collect()}
    assert facts == {3: True, 4: False, 6: True}
    assert failed == {1: "501", 2: "404", 3: "400", 5: "404", 6: "400", 7: "501"}
    banned = {k for k, v in facts.items() if v}
    assert banned <= failed.keys()                  # a 400 lands in both tables
    assert len(facts) + len(failed) - len(banned) == len(CASES)


def test_messages_logs_and_content(reqs, names):
    decided = D.decide(reqs, names).cache()
    msgs = {r.request_id: bytes(r.value).decode() for r in D.banned_messages(decided).collect()}
    assert msgs == {3: "iran", 6: "sudan"}
    logs = {r.request_id: (r.severity, r.message) for r in D.log_records(decided).collect()}
    assert logs[1] == ("ERROR", "get_files 501 - POST method not implemented")
    assert logs[5] == ("WARNING", "get_files 404 - Requested file not found: 9.html")
    assert logs[3] == ("ERROR", "get_files 400 - Requests from iran are forbidden")
    assert 2 not in logs
    served = {r.request_id: r.content for r in D.served_content(decided, names).collect()}
    assert served == {2: "<p>one</p>", 4: "<p>one</p>"}


def test_not_found_is_anti_join(reqs, names):
    nf = D.not_found(reqs, names)
    assert nf.columns == ["request_id", "file_name"]
    assert sorted(r.request_id for r in nf.collect()) == [5]


def test_vm_counts_unknown(spark):
    df = spark.createDataFrame([("www1",), (None,), ("www2",), ("www1",)], "vm_name STRING")
    got = {r.vm_name: r.responses for r in D.responses_by_vm(df).collect()}
    assert got == {"www1": 2, "www2": 1, "Unknown": 1}


def test_invariant_on_driver_data(spark):
    decided = D.decide(T.requests_raw(spark, SF_MID), T.files(spark, SF_MID)).cache()
    counts = {r.status: r["count"] for r in decided.groupBy("status").count().collect()}
    assert counts == {200: 2162, 400: 2675, 404: 3149, 501: 2014}
    n_req = D.fact_requests(decided).count()
    n_fail = D.fact_failed_requests(decided, F.current_timestamp()).count()
    assert (n_req, n_fail) == (4837, 7838)
    assert n_req + n_fail - counts[400] == 10000


def test_log_records_sink_by_severity(spark, reqs, names, tmp_dir):
    from linkflow.sources.sinks import write_log_records
    path = write_log_records(D.log_records(D.decide(reqs, names)), tmp_dir + "/logs")
    back = spark.read.json(path)
    got = {r.severity: r["count"] for r in back.groupBy("severity").count().collect()}
    assert got == {"ERROR": 4, "WARNING": 1}


def test_duplicate_names_do_not_duplicate_requests(spark, reqs):
    names = spark.createDataFrame([("1.html",), ("1.html",)], "file_name STRING")
    assert D.decide(reqs, names).count() == len(CASES)


def test_hot_files_are_split_by_aqe(spark):
    """A third of the requests ask for one file, and joins do not broadcast:
    its partition is split, and the decision is that of the broadcast join."""
    raw = T.requests_raw(spark, SF_MID).withColumn(
        "path", F.when(F.col("request_id") % 3 == 0, F.lit("/files_get/1.html"))
        .otherwise(F.col("path"))).repartition(8)
    files = T.files(spark, SF_MID)
    cols = ["request_id", "status", "file_name"]
    plain = sorted(map(tuple, D.decide(raw, files).select(cols).collect()))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        decided = D.decide(raw, files)
        split = sorted(map(tuple, decided.select(cols).collect()))
        decided.collect()
        plan = decided._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert split == plain and len(plain) == 10000
    assert "skew=true" in plan and "SinglePartition" not in plan


def test_lookup_on_a_stream_needs_no_count(spark, tmp_dir):
    """A stream joins a listing of any size: nothing is counted at its start."""
    from linkflow.streaming import requests_stream as S
    schema = T.table(spark, SF_MID, "events").schema
    decided = D.decide(S.request_stream(spark, SF_MID, schema), T.files(spark, SF_MID))
    assert decided.isStreaming
    query = S._start(D.decision_view(decided).writeStream.format("parquet"), f"{tmp_dir}/c", True, f"{tmp_dir}/o")
    S.wait(query)
    want = D.decision_view(D.decide(T.requests_raw(spark, SF_MID), T.files(spark, SF_MID)))
    got = spark.read.parquet(f"{tmp_dir}/o")
    assert got.exceptAll(want).count() == 0 and got.count() == 10000


def test_wait_stops_a_stream_at_its_time_out(spark, tmp_dir):
    from linkflow.streaming import requests_stream as S
    schema = T.table(spark, SF_MID, "events").schema
    query = S.vm_counts_stream(S.request_stream(spark, SF_MID, schema), f"{tmp_dir}/o", f"{tmp_dir}/c", available_now=False)
    assert query.isActive
    S.wait(query, timeout=1)
    assert not query.isActive


def test_null_method_is_logged_as_none(spark):
    df = spark.createDataFrame([(1, None, "/files_get/1.html", "France")], "request_id long, method string, path string, x_country string")
    names = spark.createDataFrame([("1.html",)], "file_name string")
    assert D.log_records(D.decide(df, names)).first().message == "get_files 501 - None method not implemented"
