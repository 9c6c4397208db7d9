"""Min-max scores over all rows and ranks over the rankable ones."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opquality.functions.numbers import half_even

SCORE_DIGITS = 2


def normalized(frame: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """Adds each term rescaled to 0..1 over the whole frame; a constant term is 0.

    The bounds are one row, from the shuffle that ``frame`` itself has.
    """
    bounds = []
    for name, term in terms.items():
        bounds += [F.min(term).alias(f"{name}_lo"), F.max(term).alias(f"{name}_hi")]
    limits = frame.agg(*bounds).withColumn("_one", F.lit(1))

    def rescale(name: str, term: Column) -> Column:
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(high == low, F.lit(0.0)).otherwise((term - low) / F.nullif(high - low, F.lit(0.0)))

    # one row of limits
    bounded = frame.withColumn("_one", F.lit(1)).join(F.broadcast(limits), "_one")
    return bounded.select(*[F.col(c) for c in frame.columns], *[rescale(name, term).alias(name) for name, term in terms.items()])


def scored(frame: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """Quality score 0..100 (lower is better): the mean of the rescaled terms."""
    scaled = normalized(frame, terms)
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in terms]) / len(terms)
    return scaled.withColumn("QUALITY_SCORE", half_even(mean * 100, SCORE_DIGITS))


def ranked(frame: DataFrame, score: str = "QUALITY_SCORE", eligible: str = "RANKABLE", rank: str = "RANK") -> DataFrame:
    """Competition rank by score among the eligible rows, NULL for the others.

    The score has two decimals between 0 and 100, hence at most 10,001 distinct
    values: ranks are read off their histogram, which is bounded whatever the
    number of rows, in place of a window over the whole table.
    """
    counts = frame.where(F.col(eligible)).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        F.col(score).alias("_score"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias(rank),
    )
    matches = F.col(eligible) & (F.col(score) == F.col("_score"))
    return frame.join(F.broadcast(ranks), matches, "left").drop("_score")


def scored_and_ranked(frame: DataFrame, terms: Mapping[str, Column], min_volume: float = 100, volume: str = "TIRES_BUILT") -> DataFrame:
    """RANKABLE, the rescaled terms, QUALITY_SCORE and RANK on an aggregated frame.

    Bounds, ranks and rows all read the aggregate ``frame``, whose shuffle Spark
    runs once.
    """
    rankable = F.coalesce(F.col(volume) >= min_volume, F.lit(False))
    return ranked(scored(frame.withColumn("RANKABLE", rankable), terms))
