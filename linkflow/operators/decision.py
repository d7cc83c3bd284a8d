"""Request adjudication and the rows it produces.

A request is judged in this order:

1. method other than GET -> 501 (checked before the country);
2. normalised country in the ban list -> 400 (a missing country is allowed);
3. file name found in the corpus listing -> 200, else 404.

``missing_country="not_found"`` is the variant that records facts: an allowed
request without a country header cannot be stored and ends as 404.

From one decision plan come the fact rows (``requests``: 200 and 400;
``failed_requests``: every refusal), the topic messages for 400, the log
records and the served content.

The lookup joins request file names to the corpus *names*; contents are joined
only for the 200 rows. It is a plain join without counts or hints: Spark
broadcasts a listing whose bytes are small, and otherwise AQE splits the
partitions of files that many requests ask for. A stream judges each
micro-batch against a written listing (:mod:`linkflow.streaming.listing`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.functions import requests as R
from linkflow.plans.joins import split_join

MISSING_COUNTRY = ("allow", "not_found")


def prepare_requests(raw: DataFrame) -> DataFrame:
    """Add ``file_name`` (last path segment) and ``country`` (normalised)."""
    return raw.withColumn("file_name", R.file_name_of(F.col("path"))).withColumn(
        "country", R.normalise_country(F.col("x_country")))


def status_column(missing_country: str = "allow", health: bool = False) -> Column:
    if missing_country not in MISSING_COUNTRY:
        raise ValueError(f"missing_country must be one of {MISSING_COUNTRY}")
    found = F.coalesce(F.col("found"), F.lit(False))
    if missing_country == "not_found":
        found = found & F.col("country").isNotNull()
    status = F.when(F.coalesce(F.col("method"), F.lit("")) != "GET", F.lit(501))
    if health:
        status = F.when(is_health_check(), F.lit(200)).otherwise(
            status.when(R.is_banned(F.col("country")), F.lit(400))
            .when(found, F.lit(200)).otherwise(F.lit(404)))
        return status
    return status.when(R.is_banned(F.col("country")), F.lit(400)).when(
        found, F.lit(200)).otherwise(F.lit(404))


HEALTH_PATH = "/health"


def is_health_check() -> Column:
    return (F.col("path") == HEALTH_PATH) & (F.col("method") == "GET")


def reason_column(status: Column, health: bool = False) -> Column:
    reason = (F.when(status == 501, F.lit(R.TEXT_NOT_IMPLEMENTED))
              .when(status == 400, F.lit(R.TEXT_PERMISSION_DENIED))
              .when(status == 404, F.concat(F.lit("No such object: "), F.col("file_name")))
              .otherwise(F.lit("OK")))
    if not health:
        return reason
    # A health check is answered by the machine with its name.
    return F.when(is_health_check(), F.concat(F.lit("OK: "), F.coalesce(F.col("vm_name"), F.lit("Unknown")))).otherwise(reason)


def decide(requests: DataFrame, corpus_names: DataFrame, *,
           missing_country: str = "allow", health: bool = False,
           listed: bool = False) -> DataFrame:
    """Judge raw requests against the corpus listing.

    ``requests`` has ``request_id, method, path, x_country, ...``;
    ``corpus_names`` has one row per stored file, column ``file_name``;
    ``listed``: it is a written listing that has each name once. With
    ``health``, a GET of ``/health`` is answered by the machine (``vm_name``)
    that it reached, whatever its country. Returns the request columns plus ``file_name, country, status, reason``.
    """
    prepared, found = prepare_requests(requests), F.lit(True).alias("found")
    if listed:
        joined = prepared.join(corpus_names.select("file_name", found), "file_name", "left")
    else:
        # distinct(): a name listed twice must not duplicate requests.
        names = corpus_names.select("file_name").distinct().select("file_name", found)
        joined = split_join(prepared, names, "file_name")
    status = status_column(missing_country, health)
    return (joined.withColumn("status", status)
            .withColumn("reason", reason_column(F.col("status"), health))
            .drop("found"))


def decision_view(decided: DataFrame) -> DataFrame:
    return decided.select("request_id", "method", "file_name", "country", "status", "reason")


def served_content(decided: DataFrame, corpus: DataFrame) -> DataFrame:
    """Body of every 200 response: ``(request_id, file_name, content)``."""
    served = decided.where(F.col("status") == 200).select("request_id", "file_name")
    return served.join(corpus.select("file_name", "content"), "file_name")


def not_found(requests: DataFrame, corpus_names: DataFrame) -> DataFrame:
    """Allowed GET requests whose file is not stored: ``(request_id, file_name)``."""
    allowed = prepare_requests(requests).where(
        (F.coalesce(F.col("method"), F.lit("")) == "GET") & ~R.is_banned(F.col("country")))
    # An anti join: a name listed twice changes nothing.
    return allowed.join(corpus_names.select("file_name"), "file_name", "left_anti").select("request_id", "file_name")


# --- rows derived from one decision ----------------------------------------

def fact_requests(decided: DataFrame) -> DataFrame:
    """``requests`` table rows: served (200) and refused-by-country (400)."""
    return decided.where(F.col("status").isin(200, 400)).select(
        "request_id",
        F.col("x_gender").alias("gender"),
        F.col("x_age").alias("age"),
        F.col("x_income").alias("income"),
        F.col("x_time").cast("timestamp").alias("time"),
        F.col("x_client_ip").alias("ip_address"),
        "file_name",
        "country",
        (F.col("status") == 400).alias("is_banned"))


def fact_failed_requests(decided: DataFrame, now: Column | None = None) -> DataFrame:
    """``failed_requests`` rows for 400, 404 and 501; ``time`` is the server time."""
    now = F.current_timestamp() if now is None else now
    return decided.where(F.col("status") != 200).select(
        F.col("request_id").alias("failed_request_id"),
        now.cast("timestamp").alias("time"),
        "file_name",
        F.col("status").cast("string").alias("error_code"))


def banned_messages(decided: DataFrame) -> DataFrame:
    """Topic messages: the banned country as UTF-8 bytes, keyed by request."""
    return decided.where(F.col("status") == 400).select(
        "request_id", R.utf8(F.col("country")).alias("value"))


def log_records(decided: DataFrame) -> DataFrame:
    """Severity-tagged log records for every refused request."""
    status = F.col("status")
    return decided.where(status != 200).select(
        "request_id",
        R.log_severity(status).alias("severity"),
        "status",
        R.log_message(status, F.col("method"), F.col("file_name"), F.col("country")).alias("message"))


def responses_by_vm(responses: DataFrame) -> DataFrame:
    """Responses per serving VM; a missing VM header counts as ``Unknown``."""
    return responses.groupBy(F.coalesce(F.col("vm_name"), F.lit("Unknown")).alias("vm_name")).agg(
        F.count(F.lit(1)).alias("responses"))
