"""Lenient timestamps, calendar parts and week labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_datetime(column: Column, data_type: T.DataType, formats: Iterable[str] = ()) -> Column:
    """Zone-less timestamp; text that is no date becomes NULL instead of failing.

    ``formats`` are extra patterns tried, in order, after the ISO forms.
    """
    if isinstance(data_type, T.TimestampNTZType):
        return column
    if isinstance(data_type, T.StringType):
        tries = [column.try_cast("timestamp_ntz")]
        tries += [F.try_to_timestamp(F.trim(column), F.lit(f)).cast("timestamp_ntz") for f in formats]
        return F.coalesce(*tries)
    if isinstance(data_type, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    return column.cast("string").try_cast("timestamp_ntz")


def calendar_parts(stamp: Column, day_of_week: bool = False) -> dict[str, Column]:
    """Calendar year and month with the ISO week; Monday is day 0."""
    parts = {
        "PROD_YEAR": F.year(stamp),
        "PROD_MONTH": F.month(stamp),
        "PROD_WEEK": F.weekofyear(stamp),
    }
    if day_of_week:
        parts["PROD_DOW"] = F.weekday(stamp)
    return parts


def week_label(year: Column, week: Column) -> Column:
    """``2026-W05``; NULL when either part is missing."""
    known = year.isNotNull() & week.isNotNull()
    return F.when(known, F.format_string("%d-W%02d", year, week))


def short_week_label(week: Column) -> Column:
    return F.when(week.isNotNull(), F.format_string("W%02d", week))
