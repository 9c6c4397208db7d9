"""Numbers: lenient parsing, half-even rounding, safe ratios, banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal notation only. Spark's own cast also takes Java forms such as "12d"
# or hexadecimal floats, which are codes rather than numbers here.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"

AMOUNT_TYPE = "decimal(38,9)"
# Smaller amounts are added as decimals; 10^11 of them fit the type.
DECIMAL_BELOW = 1e18
# A double this close to a decimal, relative to its size, stands for that decimal.
NOISE = 1e-15


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def nan_to_null(column: Column, data_type: T.DataType) -> Column:
    return F.when(~F.isnan(column), column) if is_floating(data_type) else column


def to_number(column: Column, data_type: T.DataType) -> Column:
    """Double, or NULL where the value is not a number."""
    if isinstance(data_type, T.StringType):
        return F.regexp_extract(column, NUMBER, 1).try_cast("double")
    return nan_to_null(column, data_type).cast("double")


def number_or_zero(column: Column, data_type: T.DataType) -> Column:
    return F.coalesce(to_number(column, data_type), F.lit(0.0))


def half_even(column: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    factor = float(10**digits)
    return F.rint(column * factor) / factor


def ratio(numerator: Column, denominator: Column, digits: int | None = 3, scale: float = 100.0) -> Column:
    """``numerator / denominator * scale``; NULL on a zero denominator."""
    value = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    if scale != 1.0:
        value = value * scale
    return value if digits is None else half_even(value, digits)


def ratio_or_zero(numerator: Column, denominator: Column, digits: int | None = 3, scale: float = 100.0) -> Column:
    return F.coalesce(ratio(numerator, denominator, digits, scale), F.lit(0.0))


def total(column: Column) -> Column:
    """Sum of a measure: 0 when there is nothing to add. Values of up to nine decimals are
    added as decimals, which no order of addition changes. What others have beyond nine
    decimals, and values too large for that, NaN and infinity too, are added as doubles."""
    value = column.cast("double")
    near = F.when(F.abs(value) < DECIMAL_BELOW, value.try_cast(AMOUNT_TYPE))
    beyond = value - near.cast("double")
    rest = F.when(near.isNull(), value).when(F.abs(beyond) > F.abs(value) * NOISE, beyond)
    return F.coalesce(F.sum(near).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))


def total_count(column: Column) -> Column:
    """Sum of whole numbers: 0 when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def band(value: Column, good: float, warn: float, low_is_good: bool = True) -> Column:
    """good / warn / bad against two limits, 'none' for a missing value."""
    if low_is_good:
        graded = F.when(value <= good, "good").when(value <= warn, "warn")
    else:
        graded = F.when(value >= good, "good").when(value >= warn, "warn")
    return F.when(value.isNull(), "none").otherwise(graded.otherwise("bad"))
