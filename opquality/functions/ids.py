"""Canonical forms of operator ids and defect codes.

Both work in steps on plain columns, so that no expression is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.numbers import is_floating, nan_to_null, to_number
from opquality.functions.staging import computed_once
from opquality.functions.text import strip, zfill

ID_WIDTH = 6
FINAL_ID = r"^[0-9]{6}$"
NO_SPACE = r"^[!-~]+$"


def number_text(number: Column) -> Column:
    """Plain decimal text of a double without trailing zeros.

    Spark writes doubles outside 1e-3..1e7 with exponents. Those go through a decimal
    that holds all their digits; 1e28 and more, and less than 1e-10, keep an exponent,
    so that no two numbers share a text and none is lost.
    """
    size = F.abs(number)
    direct = ((size >= 1e-3) & (size < 1e7)) | (number == 0)
    plain = F.when(direct, number.cast("string")).when(size < 1, number.try_cast("decimal(38,27)").cast("string")).otherwise(number.try_cast("decimal(38,10)").cast("string"))
    text = F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))
    exponent = F.regexp_replace(F.regexp_replace(F.lower(number.cast("string")), r"\.0e", "e"), r"e(\d)", "e+$1")
    return F.when((size >= 1e28) | (size < 1e-10) & (number != 0), exponent).otherwise(text)


def _long_number(text: Column) -> Column:
    """Whole part of a number written with 16 or more digits before any point, else NULL."""
    found = F.regexp_extract(text, r"^\s*(-?)\+?0*([1-9]\d{15,})(?:\.\d*)?\s*$", 1)
    digits = F.regexp_extract(text, r"^\s*-?\+?0*([1-9]\d{15,})(?:\.\d*)?\s*$", 1)
    return F.when(digits != "", F.concat(found, digits))


def _whole_part(number: Column) -> Column:
    """Text of a double without its fraction, also of those that no bigint holds."""
    return F.coalesce(number.try_cast("bigint").cast("string"), number.try_cast("decimal(38,0)").cast("string"))


def _bare_id(column: Column, data_type: T.DataType, mode: str) -> Column:
    if isinstance(data_type, T.IntegralType):
        return column.cast("string")
    if is_floating(data_type):
        known = nan_to_null(column, data_type).cast("double")
        return number_text(known) if mode == "text" else _whole_part(known)
    text = column.cast("string")
    if mode == "text":
        stripped = F.when(text.rlike(NO_SPACE), text).otherwise(strip(text))
        bare = F.regexp_replace(stripped, r"\.0+$", "")
    else:
        # The second try is for spaces outside ASCII; most ids need the first only. A whole
        # number of more digits than a double holds is read as a decimal.
        tries = [t for tried in (text, strip(text)) for t in (_long_number(tried), _whole_part(to_number(tried, T.StringType())))]
        bare = F.coalesce(*tries, strip(text))
    # Most ids are in their final form already.
    return F.when(text.rlike(FINAL_ID), text).otherwise(bare)


def normalized_ids(df: DataFrame, source: str = "OP_ID", mode: str = "numeric", target: str = "OP_ID") -> DataFrame:
    """Operator ids of ``source`` padded to six characters, as ``target``.

    ``numeric``: anything that reads as a number is cut to its whole part first
    (``12.7`` and ``1e3`` become ``000012`` and ``001000``), also numbers of
    more digits than a double holds.
    ``text``: only a trailing ``.0`` is dropped, the rest is kept as written.
    """
    if mode not in ("numeric", "text"):
        raise ValueError(f"unknown id mode: {mode}")
    bare = _bare_id(F.col(f"`{source}`"), df.schema[source].dataType, mode)
    staged = df.withColumn("_BARE", bare)
    return computed_once(staged, target, zfill(F.col("_BARE"), ID_WIDTH)).drop("_BARE")


def dimension_key(column: Column) -> Column:
    """Form under which the operator dimension is looked up."""
    return F.upper(strip(column.cast("string")))


def canonical_codes(df: DataFrame, source: str = "CQ_CODE", target: str = "CQ_CODE_STR") -> DataFrame:
    """Defect codes as text: numbers in shortest decimal form, others stripped."""
    column, data_type = F.col(f"`{source}`"), df.schema[source].dataType
    if isinstance(data_type, T.IntegralType):
        return df.withColumn(target, column.cast("string"))
    staged = df.withColumn("_NUMBER", to_number(column, data_type))
    text = number_text(F.col("_NUMBER"))
    if not is_floating(data_type):
        text = F.coalesce(text, strip(column.cast("string")))
    return computed_once(staged, target, text).drop("_NUMBER")
