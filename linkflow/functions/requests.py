"""Column expressions for request rows: headers, file names, IPs, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Countries whose requests are refused (lower case, exact membership).
BANNED_COUNTRIES = ["north korea", "iran", "cuba", "myanmar", "iraq", "libya",
                    "sudan", "zimbabwe", "syria"]
# Response texts and log formats per status.
TEXT_NOT_IMPLEMENTED = "Not Implemented"
TEXT_PERMISSION_DENIED = "Permission Denied"
LOG_501 = "get_files 501 - %s method not implemented"
LOG_404 = "get_files 404 - Requested file not found: %s"
LOG_400 = "get_files 400 - Requests from %s are forbidden"
# IP digits are base 255, the fourth octet in 0..254.
IP_BASE = 255
# ---------------------------------------------------------------------------


def normalise_country(country: Column) -> Column:
    """Lower case, Unicode whitespace stripped at both ends; NULL stays NULL.

    ``trim`` alone would leave tabs and other whitespace.
    """
    return F.lower(F.regexp_replace(country, r"(?U)^\s+|\s+$", ""))


def is_banned(country: Column) -> Column:
    """Exact membership in the ban list; a missing country is not banned."""
    return F.coalesce(country.isin(BANNED_COUNTRIES), F.lit(False))


def file_name_of(path: Column) -> Column:
    """Last path segment: ``/files_get/12.html`` -> ``12.html``."""
    return F.substring_index(path, "/", -1)


def ip_from_cidr(cidr: Column, octet4: Column) -> Column:
    """Dotted IP whose first three octets are the base-255 digits of ``cidr``."""
    o3 = F.pmod(cidr, F.lit(IP_BASE))
    rest = F.floor(cidr / IP_BASE)
    o2 = F.pmod(rest, F.lit(IP_BASE))
    o1 = F.floor(rest / IP_BASE)
    return F.concat_ws(".", *[c.cast("bigint").cast("string") for c in (o1, o2, o3, octet4)])


def request_path(bucket: str, directory: str, index: Column) -> Column:
    """``[/bucket][/dir]/<index>.html``; ``'none'`` or ``''`` leaves a part out."""
    prefix = "".join("/" + p for p in (bucket, directory) if p and p != "none")
    return F.concat(F.lit(prefix + "/"), index.cast("string"), F.lit(".html"))


def hour_text(day: Column, hour: Column) -> Column:
    """The time header ``yyyy-MM-dd HH:00:00`` of a date and an hour."""
    return F.format_string("%s %02d:00:00", day.cast("string"), hour)


def hour_time(day: Column, hour: Column) -> Column:
    """The header's time as a timestamp."""
    return F.to_timestamp(hour_text(day, hour))


def utf8(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def from_utf8(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def log_message(status: Column, method: Column, file_name: Column,
                country: Column) -> Column:
    """Log text for a refused request; NULL for 200."""
    return (F.when(status == 501, F.format_string(LOG_501, F.coalesce(method, F.lit("None"))))
            .when(status == 404, F.format_string(LOG_404, file_name))
            .when(status == 400, F.format_string(LOG_400, country)))


def log_severity(status: Column) -> Column:
    return (F.when(status.isin(501, 400), F.lit("ERROR"))
            .when(status == 404, F.lit("WARNING")))
