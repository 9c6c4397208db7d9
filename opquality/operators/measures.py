"""Combining measures that share a grain, without chains of outer joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opquality.functions.numbers import ratio, total, total_count
from opquality.operators.lookup import Lookup
from opquality.sources.readers import file_sizes

COUNT, AMOUNT = "count", "amount"
# Rows from so many bytes of files are grouped by one task.
BYTES_A_PLACE = 8 << 20


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a measure a part does not carry is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sums(measures: Mapping[str, str]) -> list[Column]:
    return [
        (total_count if kind == COUNT else total)(F.col(name)).alias(name)
        for name, kind in measures.items()
    ]


def combine(parts: Sequence[DataFrame], keys: Sequence[str], measures: Mapping[str, str], fine: bool = False) -> DataFrame:
    """Full outer combination of several measures on common keys.

    Stacking and summing needs one shuffle of map-side combined rows, treats
    missing keys as equal, and fills absent measures with 0, which a chain of
    outer joins would each need extra work for. ``fine``: there are nearly as many
    groups as rows, see ``dealt``.
    """
    rows = dealt(parts, keys) if fine else stack(parts)
    return rows.groupBy(*keys).agg(*sums(measures))


def dealt(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The stacked rows by key in as many places as their files have pieces of
    BYTES_A_PLACE, for keys of which most rows have one of their own.

    Map-side combining would then hold a group per row and still pass on every row, in
    as few tasks as there are cores or large pieces of a file. Here the rows of a key
    come together first, and what a task holds does not grow with the input. Rows that
    come from no file are dealt as Spark sees fit.
    """
    rows = stack(parts)
    files = [part.inputFiles() for part in parts]
    sizes = file_sizes(rows.sparkSession, {f for names in files for f in names})
    read = sum(sizes.get(f, 0) for names in files for f in names)
    places = [-(-read // BYTES_A_PLACE)] if read else []
    return rows.repartition(*places, *[F.col(k) for k in keys])


def combine_onto(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Left combination: only the keys that occur in ``base`` are kept."""
    marked = [base.withColumn("_IN_BASE", F.lit(1))] + list(others)
    rolled = stack(marked).groupBy(*keys).agg(*sums(measures), F.max("_IN_BASE").alias("_IN_BASE"))
    return rolled.where(F.col("_IN_BASE") == 1).drop("_IN_BASE")


def best_per_item(tests: DataFrame, keys: Sequence[str], item: str, flag: str) -> DataFrame:
    """Per key and item the best flag of its tests, as rows of two measures.

    A missing item is a group of its own: it is not counted as tested but its
    flag still adds up.
    """
    slim = tests.select(*keys, item, flag)
    per_item = dealt([slim], [*keys, item]).groupBy(*keys, item).agg(F.max(flag).alias("_FLAG"))
    return per_item.select(
        *keys,
        F.col(item).isNotNull().cast("long").alias("UNI_TESTED"),
        F.col("_FLAG").cast("long").alias("UNI_RFT"),
    )


def with_share_of_total(
    cells: DataFrame, value: str, add_up: Callable[[Column], Column], by: Sequence[str], total_name: str, share_name: str, digits: int = 2
) -> DataFrame:
    """Adds the total over ``by`` and the percentage each cell has in it.

    Both are NULL where a ``by`` column is missing. The totals are aggregated
    and joined back, so a group of any size is never gathered in one task.
    """
    totals = cells.groupBy(*by).agg(add_up(F.col(value)).alias(total_name))
    joined = Lookup(totals, tuple(by)).left_join(cells)
    return joined.select(*cells.columns, total_name).withColumn(
        share_name, ratio(F.col(value), F.col(total_name), digits)
    )
