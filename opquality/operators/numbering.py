"""Dense numbers, pages and running totals over a total order, without one big task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opquality.operators.sharing import share
from opquality.sources.columns import col

# monotonically_increasing_id() keeps the row's place within its partition in
# the lower 33 bits (public contract of the function).
PLACE_BITS = 33
# Ranges are told apart by expressions, so there are not more than this; each is sorted
# by a task, which spills what it cannot hold.
MOST_RANGES = 256
# Keys sampled for each range.
SAMPLED = 32


@dataclass(frozen=True)
class SortKey:
    """A column to sort by. Missing values come last, or first with ``nulls_first``."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def before(self, value) -> Column:
        """Whether a row's key comes before this one."""
        c = col(self.name)
        if value is None:
            return F.lit(False) if self.nulls_first else c.isNotNull()
        earlier = (c > F.lit(value)) if self.descending else (c < F.lit(value))
        return F.coalesce(earlier, F.lit(self.nulls_first))


class Ranges:
    """Rows of a table in consecutive ranges of a total order.

    Splitters are chosen from a sample of keys and become literals, so a row's range is an
    expression, the same in every job. The rows of each range are counted in one aggregate.
    Neither rows nor keys are stored; which splitters the sample gives changes the size of
    ranges and no number. Rows equal in all keys are told apart by a hash of their other
    columns, which also lets a large group of them spread over ranges.
    """

    def __init__(self, df: DataFrame, order: Sequence[SortKey], ranges: int | None = None):
        wanted = ranges or min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        named = [k.name for k in order]
        others = [c for c in df.columns if c not in named]
        self.columns = df.columns
        self.order = [*order, SortKey("_tie")]
        rows = df.withColumn("_tie", F.xxhash64(*[col(c) for c in others]) if others else F.lit(0).cast("long"))
        keys = rows.select(*[col(k.name) for k in self.order])
        # At most a few thousand keys, sorted by Spark itself.
        sample = keys.orderBy(F.rand(5)).limit(SAMPLED * wanted).orderBy(*self._order()).collect()
        picked = [tuple(sample[i * len(sample) // wanted]) for i in range(1, wanted)] if sample else []
        self.splitters = list(dict.fromkeys(picked))
        self.rows = rows.withColumn("_range", self._range(0, len(self.splitters)))
        # One row per range.
        counts = {r["_range"]: r["count"] for r in self.rows.groupBy("_range").count().collect()}
        sizes = [counts.get(i, 0) for i in range(len(self.splitters) + 1)]
        self.offsets = list(accumulate(sizes, initial=0))

    def _order(self) -> list[Column]:
        return [k.order() for k in self.order]

    def _before(self, splitter: tuple) -> Column:
        found = F.lit(False)
        for key, value in reversed(list(zip(self.order, splitter))):
            found = key.before(value) | (col(key.name).eqNullSafe(F.lit(value)) & found)
        return found

    def _range(self, low: int, high: int) -> Column:
        """Place among the splitters, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(self._before(self.splitters[middle]), self._range(low, middle)).otherwise(self._range(middle + 1, high))

    def numbered(self, name: str, start: Column | int = 1, chosen: DataFrame | None = None) -> DataFrame:
        """Consecutive numbers from ``start`` as the first column."""
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*self._order()))
        offset = F.get(F.array(*[F.lit(n).cast("long") for n in self.offsets]), F.col("_range"))
        first = start if isinstance(start, Column) else F.lit(start)
        number = (offset + place - 1 + first).cast("long").alias(name)
        return (self.rows if chosen is None else chosen).select(number, *[col(c) for c in self.columns if c != name])

    def page(self, offset: int, limit: int, name: str = "POSITION") -> DataFrame:
        """Rows number offset + 1 to offset + limit: only the ranges that hold them are
        shuffled and sorted, wherever in the table they lie."""
        asked = [i for i in range(len(self.offsets) - 1) if self.offsets[i] < offset + limit and self.offsets[i + 1] > offset]
        chosen = self.rows.where(F.col("_range").isin(asked)) if asked else self.rows.limit(0)
        return self.numbered(name, chosen=chosen).where((F.col(name) > offset) & (F.col(name) <= offset + limit))


def dense_numbers(df: DataFrame, order_by: Sequence[SortKey] = (), name: str = "row_id", start: Column | int = 1) -> DataFrame:
    """Consecutive numbers from ``start`` as the first column.

    With ``order_by`` rows are numbered in that order, by ranges of it, see ``Ranges``.
    Without it the rows keep the order they are read in and nothing is shuffled; as only a
    stored table is read in one order twice, it is stored first.
    """
    columns = [col(c) for c in df.columns if c != name]
    rows = df.select(*columns)
    if order_by:
        return Ranges(df if name in [k.name for k in order_by] else rows, order_by).numbered(name, start)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = share(rows.withColumns({"_part": F.spark_partition_id(), "_place": place}))
    # one row per partition
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    numbered = placed.join(F.broadcast(offsets), "_part")
    number = (F.col("_offset") + F.col("_place") + first).cast("long")
    return numbered.select(number.alias(name), *columns)
