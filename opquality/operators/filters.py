"""Row filters shared by the tables and reports."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.text import strip

def text_id(value: str) -> str:
    """An operator id as the tables of this engine hold it: without a trailing ``.0``,
    padded to six characters."""
    return re.sub(r"\.0+$", "", str(value).strip()).zfill(6)


CONFECTION, FINISHING = "Confection", "Finishing"


def _in(df: DataFrame, name: str, values: Sequence) -> Column:
    """Membership with the values cast to the column's own type."""
    kind = df.schema[name].dataType
    return F.col(name).isin(*[F.lit(v).cast(kind) for v in values])


def day_ranges(years: Sequence[int], weeks: Sequence[int] = ()) -> list[tuple[date, date]]:
    """The days of these calendar years that lie in these ISO weeks (all, if none are
    given), as ranges from the first day to the one after the last."""
    ranges: list[tuple[date, date]] = []
    for year in sorted(set(map(int, years))):
        day, one = date(year, 1, 1), timedelta(1)
        while day.year == year:
            if not weeks or day.isocalendar().week in weeks:
                if ranges and ranges[-1][1] == day:
                    ranges[-1] = ranges[-1][0], day + one
                else:
                    ranges.append((day, day + one))
            day += one
    return ranges


@dataclass(frozen=True)
class Filters:
    """Dashboard selection. Empty parts do not filter, and a part whose column
    the table lacks is ignored. Weeks are week numbers of any year unless
    ``years`` is given as well."""

    bus: Sequence[str] = ()
    crews: Sequence[int] = ()
    weeks: Sequence[int] = ()
    years: Sequence[int] = ()
    op_id: str | None = None

    def apply(self, df: DataFrame, known_bu_only: bool = False) -> DataFrame:
        if known_bu_only and "BU" in df.columns:
            df = df.where(F.col("BU").isNotNull())
        for names, values in (
            (("BU",), self.bus),
            (("CREW",), self.crews),
            (("PROD_WEEK", "WEEK"), self.weeks),
            (("PROD_YEAR", "YEAR"), self.years),
        ):
            name = next((n for n in names if n in df.columns), None)
            if values and name:
                df = df.where(_in(df, name, values))
        if self.years and "PROD_DATE" in df.columns and isinstance(df.schema["PROD_DATE"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            # The same days as ranges of dates, which reach the files where years and weeks are derived.
            day, kind = F.col("PROD_DATE"), df.schema["PROD_DATE"].dataType
            ranges = [(day >= F.lit(a).cast(kind)) & (day < F.lit(b).cast(kind)) for a, b in day_ranges(self.years, self.weeks)]
            df = df.where(reduce(lambda a, b: a | b, ranges) if ranges else F.lit(False))
        if self.op_id and "OP_ID" in df.columns:
            # A plain comparison, which reaches the files of a table.
            text = isinstance(df.schema["OP_ID"].dataType, T.StringType)
            df = df.where((F.col("OP_ID") if text else F.col("OP_ID").cast("string")) == text_id(self.op_id))
        return df


def since(df: DataFrame, min_date: str | None, column: str = "PROD_DATE") -> DataFrame:
    """Rows on or after a date; missing dates go. None keeps everything."""
    if min_date is None or column not in df.columns:
        return df
    return df.where(F.col(column) >= F.lit(min_date).cast("timestamp_ntz"))


def matches_step(relates_to: str, column: str = "CQ_RELATES_TO") -> Column:
    return F.coalesce(F.lower(strip(F.col(column))) == relates_to.lower(), F.lit(False))


def of_step(df: DataFrame, relates_to: str | None, column: str = "CQ_RELATES_TO") -> DataFrame:
    """Events of one production step; a table without the split is kept whole."""
    if relates_to is None or column not in df.columns:
        return df
    return df.where(matches_step(relates_to, column))


def of_step_or_all(df: DataFrame, relates_to: str | None, column: str = "CQ_RELATES_TO") -> DataFrame:
    """As ``of_step``, but all rows when not a single one matches."""
    if relates_to is None or column not in df.columns:
        return df
    any_match = df.agg(F.max(matches_step(relates_to, column))).scalar()
    return df.where(matches_step(relates_to, column) | ~any_match)


def with_code(df: DataFrame, column: str = "CQ_CODE_STR") -> DataFrame:
    return df.where(F.col(column).isNotNull())
