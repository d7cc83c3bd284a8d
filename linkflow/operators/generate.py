"""Synthetic corpus and request rows, generated in parallel from id tables.

Every random draw is a hash of ``'<id>:<seed>:<salt>'``: the first 32 bits of
its MD5, taken modulo the range. Draws therefore do not depend on how the ids
are partitioned or on the order tasks run, a retried task reproduces its rows,
and DuckDB can recompute them. Only the distributions and value domains of the
single-machine generators are kept, not their random streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkflow.functions import requests as R

# --- fixed values -----------------------------------------------------------
# Page layout of a generated corpus file.
PAGE_HEADER = "<!DOCTYPE html>\n<html>\n<body>\n"
PAGE_FOOTER = "</body>\n</html>\n"
PAGE_TEXT = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor "
    "incididunt ut labore et dolore magna aliqua. Ut enim ad\nminim veniam, quis nostrud "
    "exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure "
    "dolor in reprehenderit in voluptate velit esse\ncillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt "
    "mollit anim id est laborum.\n<p>\n")
LINK_OPEN = '<a HREF="'
LINK_CLOSE = '.html"> This is a link </a>\n<p>\n'

# Request header domains.
COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda",
    "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan", "Bahamas", "Bahrain",
    "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan", "Bolivia",
    "Bosnia and Herzegovina", "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso",
    "Burundi", "Cabo Verde", "Cambodia", "Cameroon", "Canada", "Central African Republic",
    "Chad", "Chile", "China", "Colombia", "Comoros", "Congo, Democratic Republic of the",
    "Congo, Republic of the", "Costa Rica", "Cote dIvoire", "Croatia", "Cuba", "Cyprus",
    "Czechia", "Denmark", "Djibouti", "Dominica", "Dominican Republic", "Ecuador", "Egypt",
    "El Salvador", "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji",
    "Finland", "France", "Gabon", "Gambia", "Georgia", "Germany", "Ghana", "Greece",
    "Grenada", "Guatemala", "Guinea", "Guinea-Bissau", "Guyana", "Haiti", "Honduras",
    "Hungary", "Iceland", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy",
    "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Kosovo", "Kuwait",
    "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya",
    "Liechtenstein", "Lithuania", "Luxembourg", "Madagascar", "Malawi", "Malaysia",
    "Maldives", "Mali", "Malta", "Marshall Islands", "Mauritania", "Mauritius", "Mexico",
    "Micronesia", "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique",
    "Myanmar", "Namibia", "Nauru", "Nepal", "Netherlands", "New Zealand", "Nicaragua",
    "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan",
    "Palau", "Palestine", "Panama", "Papua New Guinea", "Paraguay", "Peru", "Philippines",
    "Poland", "Portugal", "Qatar", "Romania", "Russia", "Rwanda", "Saint Kitts and Nevis",
    "Saint Lucia", "Saint Vincent and the Grenadines", "Samoa", "San Marino",
    "Sao Tome and Principe", "Saudi Arabia", "Senegal", "Serbia", "Seychelles",
    "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname",
    "Sweden", "Switzerland", "Syria", "Taiwan", "Tajikistan", "Tanzania", "Thailand",
    "Timor-Leste", "Togo", "Tonga", "Trinidad and Tobago", "Tunisia", "Turkey",
    "Turkmenistan", "Tuvalu", "Uganda", "Ukraine", "United Arab Emirates (UAE)",
    "United Kingdom", "United States of America (USA)", "Uruguay", "Uzbekistan", "Vanuatu",
    "Vatican City (Holy See)", "Venezuela", "Vietnam", "Yemen", "Zambia", "Zimbabwe",
]
GENDERS = ["Male", "Female"]
AGES = ["0-16", "17-25", "26-35", "36-45", "46-55", "56-65", "66-75", "76+"]
INCOMES = ["0-10k", "10k-20k", "20k-40k", "40k-60k", "60k-100k", "100k-150k", "150k-250k",
           "250k+"]
# CIDR numbers per country: 1..9, each in [1, 16000000), unique across countries.
CIDRS_PER_COUNTRY = (1, 10)
CIDR_RANGE = (1, 16_000_000)
# ---------------------------------------------------------------------------

# Extra candidate CIDRs drawn per country, so that values lost to a clash with
# an earlier country can be replaced.
CIDR_SPARES = 6


def draw(id_col: Column, seed: int, salt, modulus) -> Column:
    """Hash draw in ``[0, modulus)`` for key ``'<id>:<seed>:<salt>'``."""
    key = F.concat_ws(":", id_col.cast("string"), F.lit(str(seed)),
                      salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt)))
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    modulus = modulus if isinstance(modulus, Column) else F.lit(modulus)
    return F.pmod(head, modulus.cast("bigint"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# --- corpus -----------------------------------------------------------------

def web_corpus(ids: DataFrame, num_files: int, max_refs: int = 250, seed: int = 0,
               id_col: str = "id") -> DataFrame:
    """One HTML page per id: ``(file_name, content)``.

    Page ``i`` holds ``draw(i, 'n') mod max_refs`` links; link ``j`` points to
    ``draw(i, j) mod num_files``. Each link follows a paragraph of text.
    """
    pid = F.col(id_col)
    n_links = draw(pid, seed, "n", max_refs)
    idx = F.when(n_links > 0, F.sequence(F.lit(0).cast("bigint"), n_links - 1)).otherwise(
        F.array().cast("array<bigint>"))
    blocks = F.transform(idx, lambda j: F.concat(
        F.lit(PAGE_TEXT + LINK_OPEN), draw(pid, seed, j, num_files).cast("string"),
        F.lit(LINK_CLOSE)))
    return ids.select(
        F.concat(pid.cast("string"), F.lit(".html")).alias("file_name"),
        F.concat(F.lit(PAGE_HEADER), F.array_join(blocks, ""), F.lit(PAGE_FOOTER)).alias("content"))


# --- requests ---------------------------------------------------------------

def cidr_book(spark, seed: int = 0) -> DataFrame:
    """``(country_idx, slot, cidr)``: each country's CIDR numbers.

    A country draws ``1..9`` numbers plus spares; a number drawn by an earlier
    country (lower index, then lower draw) is lost, and the country keeps its
    first surviving numbers. The table has at most 197 x 15 rows.
    """
    lo, hi = CIDR_RANGE
    k_lo, k_hi = CIDRS_PER_COUNTRY
    ci = F.col("country_idx")
    cands = (spark.range(len(COUNTRIES)).select(F.col("id").alias("country_idx"))
             .withColumn("wanted", draw(ci, seed, "ncidr", k_hi - k_lo) + k_lo)
             .select("country_idx", "wanted",
                     F.explode(F.sequence(F.lit(0).cast("bigint"),
                                          F.col("wanted") + CIDR_SPARES - 1)).alias("draw_no"))
             .withColumn("cidr", draw(ci, seed, F.concat(F.lit("cidr"), F.col("draw_no")),
                                      hi - lo) + lo))
    first_owner = Window.partitionBy("cidr").orderBy("country_idx", "draw_no")
    kept = cands.withColumn("_r", F.row_number().over(first_owner)).where("_r = 1")
    in_country = Window.partitionBy("country_idx").orderBy("draw_no")
    return (kept.withColumn("slot", F.row_number().over(in_country) - 1)
            .where(F.col("slot") < F.col("wanted"))
            .select("country_idx", "slot", "cidr"))


def requests(ids: DataFrame, index: int = 100_000, seed: int = 0, bucket: str = "",
             directory: str = "", id_col: str = "id", day_col: str = "day") -> DataFrame:
    """One GET request per id, with the headers of the load client.

    ``ids`` has ``id_col`` and ``day_col`` (DATE: the day the request is made).
    """
    spark = ids.sparkSession
    book = cidr_book(spark, seed)
    slots = book.groupBy("country_idx").agg(F.count(F.lit(1)).alias("n_cidrs"))
    # Both tables have at most 197 x 15 rows by construction: broadcast is safe.
    book = F.broadcast(book)
    slots = F.broadcast(slots)
    rid = F.col(id_col)
    base = ids.select(rid.alias("request_id"), F.col(day_col).alias("_day"),
                      draw(rid, seed, "country", len(COUNTRIES)).alias("country_idx"))
    with_slot = base.join(slots, "country_idx").withColumn(
        "slot", draw(F.col("request_id"), seed, "cidr", F.col("n_cidrs")))
    rows = with_slot.join(book, ["country_idx", "slot"])
    r = F.col("request_id")
    return rows.select(
        "request_id",
        F.lit("GET").alias("method"),
        R.request_path(bucket, directory, draw(r, seed, "file", index)).alias("path"),
        _pick(COUNTRIES, F.col("country_idx")).alias("x_country"),
        R.ip_from_cidr(F.col("cidr"), draw(r, seed, "octet4", 255)).alias("x_client_ip"),
        _pick(GENDERS, draw(r, seed, "gender", len(GENDERS))).alias("x_gender"),
        _pick(AGES, draw(r, seed, "age", len(AGES))).alias("x_age"),
        _pick(INCOMES, draw(r, seed, "income", len(INCOMES))).alias("x_income"),
        R.hour_time(F.col("_day"), draw(r, seed, "hour", 24)).alias("x_time"))
