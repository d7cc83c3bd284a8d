"""Request queries: decision, served content, facts, messages, logs, VM counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkflow.functions import requests as R
from linkflow.operators import decision as D
from linkflow.plans.catalog import register, sql_str
from linkflow.sources import tables as T

# Server time stamped on failure rows in the registered (reproducible) checks;
# a live job uses current_timestamp().
PROCESSING_TIME = "2024-01-02 00:00:00"

_BANNED_SQL = ", ".join(sql_str(c) for c in R.BANNED_COUNTRIES)


def dec_sql(strict: bool) -> str:
    found = "f.file_name IS NOT NULL" + (" AND r.country IS NOT NULL" if strict else "")
    return f"""SELECT r.*,
       CASE WHEN coalesce(r.method, '') <> 'GET' THEN 501
            WHEN coalesce(r.country IN ({_BANNED_SQL}), false) THEN 400
            WHEN {found} THEN 200 ELSE 404 END AS status
FROM (SELECT *, string_split(path, '/')[-1] AS file_name,
             lower(regexp_replace(x_country, '^\\s+|\\s+$', '', 'g')) AS country
      FROM requests_raw) r
LEFT JOIN (SELECT DISTINCT file_name FROM files) f ON r.file_name = f.file_name"""


def _with_dec(body: str, strict: bool = False) -> str:
    return T.with_views(body, "requests_raw", "files", ctes=[("dec", dec_sql(strict))])


_REASON_SQL = """CASE status WHEN 501 THEN 'Not Implemented' WHEN 400 THEN 'Permission Denied'
            WHEN 404 THEN 'No such object: ' || file_name ELSE 'OK' END"""


def _decided(spark, sf_dir, missing_country="allow"):
    return D.decide(T.requests_raw(spark, sf_dir), T.files(spark, sf_dir),
                    missing_country=missing_country)


# --- scalar functions over the request rows ---------------------------------

@register("country_normalised", T.with_views(
    "SELECT request_id, lower(regexp_replace(x_country, '^\\s+|\\s+$', '', 'g')) AS country "
    "FROM requests_raw", "requests_raw"))
def country_normalised(spark, sf_dir):
    return T.requests_raw(spark, sf_dir).select(
        "request_id", R.normalise_country(F.col("x_country")).alias("country"))


@register("request_file_name", T.with_views(
    "SELECT request_id, string_split(path, '/')[-1] AS file_name FROM requests_raw",
    "requests_raw"))
def request_file_name(spark, sf_dir):
    return T.requests_raw(spark, sf_dir).select(
        "request_id", R.file_name_of(F.col("path")).alias("file_name"))


@register("ip_from_cidr", """
SELECT request_id, cidr,
       CAST(cidr // 255 // 255 AS VARCHAR) || '.' || CAST((cidr // 255) % 255 AS VARCHAR) || '.' ||
       CAST(cidr % 255 AS VARCHAR) || '.' || CAST(octet4 AS VARCHAR) AS ip
FROM (SELECT event_id AS request_id, (user_id * 104729 + 7919) % 16000000 AS cidr,
             event_id % 255 AS octet4 FROM events)""")
def ip_from_cidr(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    cidr = (F.col("user_id") * 104729 + 7919) % 16000000
    return ev.select(F.col("event_id").alias("request_id"), cidr.alias("cidr"),
                     (F.col("event_id") % 255).alias("octet4")).select(
        "request_id", "cidr", R.ip_from_cidr(F.col("cidr"), F.col("octet4")).alias("ip"))


# --- decisions --------------------------------------------------------------

@register("request_decision", _with_dec(
    f"SELECT request_id, method, file_name, country, status, {_REASON_SQL} AS reason FROM dec"))
def request_decision(spark, sf_dir):
    return D.decision_view(_decided(spark, sf_dir))


@register("request_decision_strict", _with_dec(
    f"SELECT request_id, method, file_name, country, status, {_REASON_SQL} AS reason FROM dec",
    strict=True))
def request_decision_strict(spark, sf_dir):
    return D.decision_view(_decided(spark, sf_dir, "not_found"))


@register("served_content", _with_dec(
    "SELECT d.request_id, d.file_name, f.content FROM dec d JOIN files f "
    "ON d.file_name = f.file_name WHERE d.status = 200"))
def served_content(spark, sf_dir):
    return D.served_content(_decided(spark, sf_dir), T.files(spark, sf_dir))


@register("not_found_requests", _with_dec(
    "SELECT request_id, file_name FROM dec WHERE status = 404"))
def not_found_requests(spark, sf_dir):
    return D.not_found(T.requests_raw(spark, sf_dir), T.files(spark, sf_dir))


@register("banned_messages", _with_dec(
    "SELECT request_id, encode(country) AS value FROM dec WHERE status = 400"))
def banned_messages(spark, sf_dir):
    return D.banned_messages(_decided(spark, sf_dir))


FACT_REQUESTS_BODY = """SELECT request_id, x_gender AS gender, x_age AS age, x_income AS income,
       CAST(x_time AS TIMESTAMP) AS time, x_client_ip AS ip_address, file_name,
       country, status = 400 AS is_banned
FROM dec WHERE status IN (200, 400)"""
FACT_REQUESTS_SQL = _with_dec(FACT_REQUESTS_BODY, strict=True)


@register("fact_requests", FACT_REQUESTS_SQL)
def fact_requests(spark, sf_dir):
    return D.fact_requests(_decided(spark, sf_dir, "not_found"))


@register("fact_failed_requests", _with_dec(
    f"""SELECT request_id AS failed_request_id, TIMESTAMP '{PROCESSING_TIME}' AS time, file_name,
               CAST(status AS VARCHAR) AS error_code
        FROM dec WHERE status <> 200""", strict=True))
def fact_failed_requests(spark, sf_dir):
    now = F.lit(PROCESSING_TIME).cast("timestamp")
    return D.fact_failed_requests(_decided(spark, sf_dir, "not_found"), now)


@register("log_records", _with_dec(
    """SELECT request_id,
              CASE WHEN status IN (501, 400) THEN 'ERROR' ELSE 'WARNING' END AS severity,
              status,
              CASE status WHEN 501 THEN 'get_files 501 - ' || method || ' method not implemented'
                          WHEN 404 THEN 'get_files 404 - Requested file not found: ' || file_name
                          ELSE 'get_files 400 - Requests from ' || country || ' are forbidden' END
                AS message
       FROM dec WHERE status <> 200"""))
def log_records(spark, sf_dir):
    return D.log_records(_decided(spark, sf_dir))


@register("responses_by_vm", T.with_views(
    "SELECT coalesce(vm_name, 'Unknown') AS vm_name, count(*) AS responses "
    "FROM requests_raw GROUP BY 1", "requests_raw"))
def responses_by_vm(spark, sf_dir):
    return D.responses_by_vm(T.requests_raw(spark, sf_dir))


@register("request_health", T.with_views(
    f"""SELECT request_id, CASE WHEN health THEN 200 ELSE status END AS status,
               CASE WHEN health THEN 'OK: ' || coalesce(vm_name, 'Unknown') ELSE {_REASON_SQL} END AS reason
        FROM (SELECT *, path = '/health' AND method = 'GET' AS health FROM dec)""",
    "requests_raw", "files", ctes=[
        ("checked", "SELECT * REPLACE (CASE WHEN request_id % 10 = 3 THEN '/health' ELSE path END AS path) FROM requests_raw"),
        ("dec", dec_sql(False).replace("FROM requests_raw", "FROM checked"))]))
def request_health(spark, sf_dir):
    """Decisions where every tenth request is a health check."""
    raw = T.requests_raw(spark, sf_dir).withColumn(
        "path", F.when(F.col("request_id") % 10 == 3, D.HEALTH_PATH).otherwise(F.col("path")))
    decided = D.decide(raw, T.files(spark, sf_dir), health=True)
    return decided.select("request_id", "status", "reason")


@register("request_hour", """SELECT event_id AS request_id, strftime(ts, '%Y-%m-%d %H:00:00') AS time_text,
       CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time FROM events""")
def request_hour(spark, sf_dir):
    """The time header of each request and the time it stands for."""
    day, hour = F.to_date("ts"), F.hour("ts")
    return T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), R.hour_text(day, hour).alias("time_text"), R.hour_time(day, hour).alias("time"))
