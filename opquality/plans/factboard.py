"""Reports computed straight from the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.functions.dates import week_label
from opquality.functions.ids import normalized_ids
from opquality.functions.numbers import ratio, ratio_or_zero, total, total_count
from opquality.operators.filters import Filters, with_code
from opquality.operators.measures import AMOUNT, COUNT, combine_onto, stack, sums
from opquality.operators.topk import top
from opquality.plans.aggregates import SCRAP, WEEK_KEYS, percentages
from opquality.sources.columns import upper_columns

EVERYTHING = Filters()

# Fixed value: event percentages above this are flagged.
EVENT_ALERT = 5


def _selected(df: DataFrame, filters: Filters) -> DataFrame:
    return filters.apply(normalized_ids(upper_columns(df)))


def _measures(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, filters: Filters, keys: tuple[str, ...]) -> tuple[DataFrame, list[DataFrame]]:
    one = F.lit(1).cast("long")
    base = _selected(prod, filters).select(*keys, F.col("TIRES_BUILT").cast("double").alias("TIRES_BUILT"))
    others = [
        with_code(_selected(bc, filters)).select(*keys, one.alias("BC_COUNT")),
        with_code(_selected(ac, filters)).select(*keys, one.alias("AC_COUNT")),
        _selected(scrap, filters).select(*keys, F.col(SCRAP).cast("double").alias("SCRAP_LBS")),
    ]
    return base, others


MEASURES = {"TIRES_BUILT": AMOUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT, "SCRAP_LBS": AMOUNT}


def fact_kpis(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """One row of totals; all four facts are summed in one aggregate."""
    base, others = _measures(prod, bc, ac, scrap, filters, ())
    totals = stack([base, *others]).agg(*sums(MEASURES))
    tires = F.col("TIRES_BUILT")
    figures = totals.withColumns(
        {
            "BC_PCT": ratio_or_zero(F.col("BC_COUNT"), tires, None),
            "AC_PCT": ratio_or_zero(F.col("AC_COUNT"), tires, None),
            "SCRAP_PER_TIRE": ratio_or_zero(F.col("SCRAP_LBS"), tires, None, scale=1.0),
        }
    )
    return figures.withColumns({"BC_ALERT": F.col("BC_PCT") > EVENT_ALERT, "AC_ALERT": F.col("AC_PCT") > EVENT_ALERT})


def event_donut(events: DataFrame, filters: Filters = EVERYTHING, n: int = 10) -> DataFrame:
    """Most frequent event descriptions; the code stands in for a missing one."""
    label = F.coalesce(F.col("CQ_DESCRIPTION"), F.col("CQ_CODE_STR")).alias("LABEL")
    counts = with_code(_selected(events, filters)).groupBy(label).agg(F.count(F.lit(1)).alias("VALUE"))
    return top(counts, n, F.desc("VALUE"), F.asc("LABEL"))


def scrap_donut(scrap: DataFrame, filters: Filters = EVERYTHING, n: int = 10) -> DataFrame:
    """Machines with the most scrap."""
    known = _selected(scrap, filters).where(F.col("TBM").isNotNull())
    amounts = known.groupBy(F.col("TBM").alias("LABEL")).agg(total(F.col(SCRAP)).alias("VALUE"))
    return top(amounts, n, F.desc("VALUE"), F.asc("LABEL"))


def fact_trend(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """Weekly totals and percentages for the weeks that have production."""
    base, others = _measures(prod, bc, ac, scrap, filters, WEEK_KEYS)
    weeks = combine_onto(base, others, WEEK_KEYS, MEASURES).withColumns(percentages()).drop("SCRAP_PCT")
    label = week_label(F.col("PROD_YEAR"), F.col("PROD_WEEK"))
    return weeks.withColumn("WEEK_LABEL", label).orderBy(*[F.asc_nulls_last(k) for k in WEEK_KEYS])


def period_best(leaderboard: DataFrame, filters: Filters = EVERYTHING, n: int = 10) -> DataFrame:
    """Best rankable operators of the period leaderboard."""
    rankable = _selected(leaderboard, Filters(bus=filters.bus, crews=filters.crews, op_id=filters.op_id)).where(F.col("RANKABLE"))
    return top(rankable, n, F.asc_nulls_last("QUALITY_SCORE"), F.asc("OP_ID"))


def leak_trend_by_id(leak_tests: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """Weekly leak share of the tests that carry a tire number."""
    weeks = _selected(leak_tests, filters).groupBy("YEAR", "WEEK").agg(
        F.count("MATRICULE").alias("CV_TIRES"), total_count(F.col("IS_LEAK")).alias("CV_LEAKS")
    )
    return weeks.withColumns(
        {
            "CV_PCT": ratio(F.col("CV_LEAKS"), F.col("CV_TIRES")),
            "WEEK_LABEL": week_label(F.col("YEAR"), F.col("WEEK")),
        }
    ).orderBy(F.asc_nulls_last("YEAR"), F.asc_nulls_last("WEEK"))


def leak_worst_known(leak_tests: DataFrame, filters: Filters = EVERYTHING, min_tests: int = 50, n: int = 10) -> DataFrame:
    """Highest leak rates among operators known by name, unit and crew."""
    keys = [c for c in ("OP_ID", "OPERATOR_NAME", "BU", "CREW") if c in upper_columns(leak_tests).columns]
    known = _selected(leak_tests, filters).dropna(subset=keys)
    rates = known.groupBy(*keys).agg(
        F.count("MATRICULE").alias("TESTED"), total_count(F.col("IS_LEAK")).alias("LEAKS")
    )
    enough = rates.withColumn("LEAK_PCT", ratio(F.col("LEAKS"), F.col("TESTED"), 2)).where(F.col("TESTED") >= min_tests)
    return top(enough, n, F.desc("LEAK_PCT"), F.asc("OP_ID"))
