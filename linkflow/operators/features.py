"""Feature preparation over the ``requests`` table.

Steps, in this order:

1. ``country``, ``file_name``, ``time`` and ``income`` are replaced by integer
   codes in order of first appearance (by ``request_id``); NULL is a value
   with its own code.
2. ``ip_address`` becomes ``ip_1..ip_4`` and is dropped.
3. The remaining string columns (by schema: ``gender``, ``age``) are one-hot
   encoded as ``<col>_<value>`` booleans, values sorted; NULL gives all false.

Codes: one aggregate over all coded columns gives each distinct value its
first id; the values of all columns are numbered at once in that order
(:func:`dense_index`), written, and joined back; AQE picks the join from the
code table's bytes and splits hot values.

Columns with many values: :func:`onehot_vectors` makes one sparse vector a column
from a written level table; no value reaches the driver or the schema.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkflow.plans.indexing import dense_index

CODED_COLUMNS = ("country", "file_name", "time", "income")


def factorize(df: DataFrame, cols=CODED_COLUMNS, order_col: str = "request_id") -> DataFrame:
    """Replace each of ``cols`` by its first-appearance code (BIGINT).

    One aggregate over the input finds the first id of every value of every
    column (values compared as text, NULL kept), one numbering their codes.
    """
    cols = list(cols)
    firsts = (_values(df, cols, order_col)
              .groupBy("_c", "_v").agg(F.min(order_col).alias("_first")))
    return _coded(df, cols, level_codes(firsts, ["_first", "_v"]))


def _values(df: DataFrame, cols: list[str], *others: str) -> DataFrame:
    """``(_c, _v)`` for each row and column: the column's place, the value as text."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v"))
        for i, c in enumerate(cols)]))
    return df.select(*others, pairs.alias("_p")).select(*others, "_p._c", "_p._v")


def level_codes(levels: DataFrame, order: list[str]) -> DataFrame:
    """``(_c, _k, _code)``, written: the distinct values of each column numbered
    in the order of ``order``."""
    numbered = dense_index(levels, order, "_code", "_c")
    return numbered.select("_c", _text_key(F.col("_v")).alias("_k"), "_code").checkpoint()


def _coded(df: DataFrame, cols: list[str], codes: DataFrame) -> DataFrame:
    """``df`` with each of ``cols`` replaced by its code."""
    out = df
    for i, c in enumerate(cols):
        table = codes.where(F.col("_c") == i).select("_k", "_code")
        coded = out.withColumn("_k", _text_key(F.col(c))).join(table, "_k", "left")
        out = coded.drop(c, "_k").withColumnRenamed("_code", c)
    return out


def _text_key(value):
    """Injective, never-NULL text form of a value (NULL -> '0', v -> '1' + v)."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value.cast("string")))


def ip_octets(df: DataFrame, ip_col: str = "ip_address", lenient: bool = False,
              drop: bool = True) -> DataFrame:
    """``ip_1..ip_4`` (INT) from a dotted IP string.

    Strict (default): a NULL, a wrong number of parts or a non-number fails
    the job. ``lenient=True`` gives NULLs instead.
    """
    parts = F.split(F.col(ip_col), r"\.")
    if not lenient:
        parts = F.when(F.size(parts) == 4, parts).otherwise(
            F.raise_error(F.concat(F.lit("malformed IP address: "),
                                   F.coalesce(F.col(ip_col), F.lit("NULL")))))
    out = df
    for i in range(4):
        part = F.element_at(parts, i + 1)
        value = part.try_cast("int") if lenient else part.cast("int")
        if lenient:
            value = F.when(F.size(F.split(F.col(ip_col), r"\.")) == 4, value)
        out = out.withColumn(f"ip_{i + 1}", value)
    return out.drop(ip_col) if drop else out


def string_columns(df: DataFrame) -> list[str]:
    """Columns of string type, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def onehot(df: DataFrame, cols: list[str] | None = None,
           levels_from: DataFrame | None = None,
           levels: dict[str, list[str]] | None = None) -> DataFrame:
    """One boolean column per distinct value of each of ``cols``; drops ``cols``.

    With ``levels`` (column -> values) the output columns are those the caller
    names, in that order, and nothing is read. Otherwise the value lists, which
    define the output schema, are read to the driver: for few values only;
    :func:`onehot_vectors` is the form for any number. ``levels_from`` reads them from
    another frame with the same columns (e.g. the input before expensive joins).
    """
    cols = list(levels or (string_columns(df) if cols is None else cols))
    if not cols:
        return df
    if levels is None:
        source = df if levels_from is None else levels_from
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols]))
        found = (source.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
                 .distinct().collect())
        levels = {c: sorted(row["v"] for row in found if row["c"] == c) for c in cols}
    dummies = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
               for c in cols for v in levels[c]]
    return df.select("*", *dummies).drop(*cols)


def onehot_vectors(df: DataFrame, cols: list[str], levels_from: DataFrame | None = None) -> DataFrame:
    """Each of ``cols`` replaced by a sparse vector ``<col>_vec`` with a one at
    the value's place among the sorted values; NULL, and a value that
    ``levels_from`` lacks, give all zeros.

    The values are numbered in a written level table and joined to the rows;
    the driver sees the number of levels of each column, no level.
    """
    source = df if levels_from is None else levels_from
    levels = _values(source, cols).where(F.col("_v").isNotNull()).distinct()
    codes = level_codes(levels, ["_v"])
    sizes = {r["_c"]: r["n"] for r in codes.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = _coded(df, cols, codes)
    for i, c in enumerate(cols):
        n = sizes.get(i, 0)
        if not n:
            out = out.withColumn(f"{c}_vec", array_to_vector(F.array().cast("array<double>"))).drop(c)
            continue
        # a code beyond the levels is what the encoder drops: all zeros
        out = out.withColumn(c, F.coalesce(c, F.lit(n)))
        nominal = out.sparkSession.createDataFrame([(float(n - 1),)], f"`{c}` double")
        encoder = OneHotEncoder(inputCols=[c], outputCols=[f"{c}_vec"], handleInvalid="keep", dropLast=True).fit(nominal)
        out = encoder.transform(out).drop(c)
    return out


def prepare_features(requests: DataFrame, order_col: str = "request_id") -> DataFrame:
    """The model frame: codes, IP octets, one-hot columns."""
    coded = factorize(requests, CODED_COLUMNS, order_col)
    octets = ip_octets(coded, "ip_address")
    rest = [c for c in string_columns(requests) if c not in CODED_COLUMNS and c != "ip_address"]
    return onehot(octets, rest, levels_from=requests)


def split_flag(id_col: str = "request_id", seed: int = 0,
               train_fraction: float = 0.7):
    """``True`` for training rows: the first 32 bits of ``md5('<id>:<seed>')``
    below ``train_fraction`` of the range. Independent of partitioning."""
    bound = format(int(train_fraction * 16 ** 8), "08x")
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))
    return F.substring(F.md5(key), 1, 8) < F.lit(bound)


def train_test_split(df: DataFrame, id_col: str = "request_id", seed: int = 0,
                     train_fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    flag = split_flag(id_col, seed, train_fraction)
    return df.where(flag), df.where(~flag)
