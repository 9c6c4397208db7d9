"""Finding columns by name pattern at plan time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def resolve_column(
    columns: Sequence[str],
    exact: Iterable[str] = (),
    suffix: str | None = None,
    contains: Iterable[str] = (),
    default: str | None = None,
    required: str | None = None,
) -> str | None:
    """First column matching, tried in the order exact, suffix, contains, default.

    ``exact`` is itself a list of preferences; ``contains`` needs every part.
    With ``required`` (a description) a miss raises and lists the columns.
    """
    for name in exact:
        for column in columns:
            if column.upper() == name.upper():
                return column
    parts = [p.upper() for p in contains]
    for column in columns:
        if suffix and column.upper().endswith(suffix.upper()):
            return column
    for column in columns:
        if parts and all(p in column.upper() for p in parts):
            return column
    if default is None and required:
        raise ValueError(f"no {required} column found; columns = {list(columns)}")
    return default


def first_column(columns: Sequence[str], exact: str, contains: str | None = None) -> str | None:
    """First column, in table order, that equals ``exact`` or holds ``contains``."""
    for column in columns:
        name = column.upper()
        if name == exact.upper() or (contains and contains.upper() in name):
            return column
    return None


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def project(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Upper-cased subset of the wanted columns; absent ones are left out."""
    want = {c.upper() for c in wanted}
    keep = [c for c in df.columns if c.upper() in want]
    return df.select(*[col(c).alias(c.upper()) for c in keep])
