"""Lookups: one row per key, and left joins to them that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opquality.sources.columns import col

# Rows without a key match nothing; they are dealt to this many places instead of one.
NO_KEY_PLACES = 1024
# Missing keys that match each other are matched in this many blocks.
NULL_BLOCKS = 32


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order_by``, then by the other columns
    in table order, missing values last.

    An aggregate rather than a ranking window: copies of a key collapse on the
    map side, so no task ever holds all rows of a hot key.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = list(order_by) + [c for c in rest if c not in order_by]
    fields = []
    for i, name in enumerate(ordered):
        fields += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_best"))
    values = {name: F.col(f"_best.v{i}").alias(name) for i, name in enumerate(ordered)}
    return best.select(*[F.col(c) if c in keys else values[c] for c in df.columns])


def first_of_bucketed(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The same from a table stored in buckets of its key: a ranking window that keeps one
    row of each key and needs no shuffle. Rows without a key, which may be many, do not
    meet in a bucket's task: the first of them is the least of each task's least."""
    ordered = list(order_by) + [c for c in df.columns if c not in keys and c not in order_by]
    order = [col(c).asc_nulls_last() for c in ordered]
    no_key = reduce(lambda a, b: a & b, [col(k).isNull() for k in keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keyed = df.where(~no_key).withColumn("_first", place).where("_first = 1").drop("_first")
    return keyed.unionByName(df.where(no_key).orderBy(*order).limit(1))


@dataclass(frozen=True)
class Lookup:
    """A keyed side table with one row per key, which is what makes the left join keep
    the number of fact rows.

    How to join is left to Spark: it broadcasts the table if its size, known before or
    measured at run time, is below ``spark.sql.autoBroadcastJoinThreshold``, and splits
    the facts of a hot key otherwise. Building a join starts no job.
    """

    table: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def of(cls, table: DataFrame, *keys: str) -> "Lookup":
        return cls(table, keys)

    def select(self, *columns: str) -> "Lookup":
        return Lookup(self.table.select(*columns), self.keys)

    def left_join(self, facts: DataFrame, spread_by: Sequence[str] = ()) -> DataFrame:
        """Facts without a key keep NULLs. They are dealt to places by the hash of the
        columns ``spread_by``, so that they meet in no task; adaptive execution splits what
        is still too much for one. Everything here is deterministic, so filters on the
        facts pass the join and reach their files.
        """
        if not spread_by:
            return facts.join(self.table, list(self.keys), "left")
        no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        place = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(NO_KEY_PLACES)) + 1
        spread = facts.withColumn("_place", F.when(no_key, place).otherwise(F.lit(0).cast("long")))
        table = self.table.withColumn("_place", F.lit(0).cast("long"))
        return spread.join(table, [*self.keys, "_place"], "left").drop("_place")


def null_safe_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, blocks: int = NULL_BLOCKS) -> DataFrame:
    """Left join in which missing keys match each other, without their meeting in one task.

    Rows with a key are joined as usual. Those without are matched all with all, as the
    definition asks: the right ones are dealt to blocks, the left ones come to every block.
    ``right`` has no column of ``left``'s names.
    """
    keyed = left.where(col(left_key).isNotNull()).join(right, col(left_key) == col(right_key), "left")
    missing, others = left.where(col(left_key).isNull()), right.where(col(right_key).isNull())
    dealt = others.withColumn("_block", F.pmod(F.xxhash64(*[col(c) for c in right.columns]), F.lit(blocks)))
    everywhere = missing.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    matched = everywhere.join(dealt, "_block").select(*keyed.columns)
    any_other = others.agg(F.count(F.lit(1)) > 0).scalar()
    alone = missing.where(~any_other).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return keyed.unionByName(matched).unionByName(alone)
