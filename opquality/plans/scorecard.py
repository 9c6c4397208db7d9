"""Live reports over the aggregates: leaderboard, KPIs, breakdowns, trends, leaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opquality.functions.dates import short_week_label
from opquality.functions.ids import normalized_ids
from opquality.functions.numbers import band, ratio, ratio_or_zero, total, total_count
from opquality.operators.filters import CONFECTION, FINISHING, Filters, matches_step
from opquality.operators.measures import AMOUNT, COUNT, combine_onto, stack, sums
from opquality.operators.scoring import scored_and_ranked
from opquality.operators.sharing import written
from opquality.operators.topk import top, with_position
from opquality.plans.aggregates import WEEK_KEYS, percentages
from opquality.sources.columns import upper_columns

STEPS = {"1": CONFECTION, "2": FINISHING}
IDENTITY = ("OP_ID", "OPERATOR_NAME", "BU", "CREW")
EVERYTHING = Filters()

# Limits for good and warn, and the alert and target levels.
LEAK_BAND = (3, 8)
BEFORE_CURE_BAND = (0.5, 2)
AFTER_CURE_BAND = (5, 20)
RFT_BAND = (95, 90)
RFT_TARGET = 90
LEAK_ALERT = 8

# What an event breakdown is drawn by, in order of preference.
BREAKDOWN_COLUMNS = ("CQ_TYPE_TIER", "CQ_DESCRIPTION", "CQ_CODE_STR")


def with_text_ids(df: DataFrame) -> DataFrame:
    """For tables that others wrote. Those of this engine hold their ids in this form
    and are read as they are, so that filters reach their files."""
    return normalized_ids(upper_columns(df), mode="text")


def _available(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def op_rollup(op_week: DataFrame | None, filters: Filters = EVERYTHING, period: DataFrame | None = None, min_tires: float = 100) -> DataFrame:
    """Leaderboard for the current selection, scored and ranked within it.

    With ``period`` given, it stands in (unit, crew and operator filters only)
    when there is no operator-by-week table or it is empty.
    """
    if op_week is None or (period is not None and not _available(op_week)):
        if period is None:
            raise ValueError("neither an operator-by-week table nor a period leaderboard is available")
        return Filters(bus=filters.bus, crews=filters.crews, op_id=filters.op_id).apply(upper_columns(period))
    rows = filters.apply(upper_columns(op_week))
    rolled = rows.groupBy(*IDENTITY).agg(
        total(F.col("TIRES_BUILT")).alias("TIRES_BUILT"),
        total_count(F.col("SHIFTS")).alias("SHIFTS_WORKED"),
        total_count(F.col("BC_COUNT")).alias("BC_COUNT"),
        total_count(F.col("AC_COUNT")).alias("AC_COUNT"),
        total(F.col("SCRAP_LBS")).alias("SCRAP_LBS"),
        total_count(F.col("UNI_TESTED")).alias("UNI_TESTED"),
        total_count(F.col("UNI_RFT")).alias("UNI_RFT"),
    )
    terms = {
        "_BC": F.coalesce(F.col("BC_PCT"), F.lit(0.0)),
        "_AC": F.coalesce(F.col("AC_PCT"), F.lit(0.0)),
        "_SCRAP": F.coalesce(F.col("SCRAP_PCT"), F.lit(0.0)),
        "_UNI": F.coalesce(100 - F.col("RFT_PCT"), F.lit(0.0)),
    }
    # Bounds and ranks are read off the written roll-up, whatever it was computed from.
    board = written(rolled.withColumns(percentages(rft=True)), "op-rollup")
    return scored_and_ranked(board, terms, min_tires).drop(*terms)


def quality_top(rollup: DataFrame, n: int = 10) -> DataFrame:
    """Best scores among rankable operators with a known name."""
    named = rollup.where(F.col("RANKABLE") & F.col("OPERATOR_NAME").isNotNull())
    return top(named, n, F.asc_nulls_last("QUALITY_SCORE"), F.asc("OP_ID"))


def scrap_top(rollup: DataFrame, n: int = 10) -> DataFrame:
    """Most scrap among operators with a known name."""
    named = rollup.where(F.col("OPERATOR_NAME").isNotNull())
    return top(named, n, F.desc_nulls_last("SCRAP_LBS"), F.asc("OP_ID"))


def rankings(rollup: DataFrame, n: int = 10) -> DataFrame:
    """The n best scores (rankable or not), and these n again in three panels
    ordered by right-first-time, after-cure and before-cure percentage."""
    best = scored_named(rollup, n)
    panels = {"SCORE": -F.col("QUALITY_SCORE"), "RFT": F.col("RFT_PCT"), "AC": F.col("AC_PCT"), "BC": F.col("BC_PCT")}
    entries = [F.struct(F.lit(name).alias("PANEL"), value.alias("_sort")) for name, value in panels.items()]
    exploded = best.withColumn("_entry", F.explode(F.array(*entries))).select(*best.columns, "_entry.*")
    shown = exploded.where(F.col("_sort").isNotNull() | (F.col("PANEL") == "SCORE"))
    return with_position(shown, F.desc_nulls_last("_sort"), F.asc("OP_ID"), by=["PANEL"]).drop("_sort")


def scored_named(rollup: DataFrame, n: int) -> DataFrame:
    named = rollup.where(F.col("OPERATOR_NAME").isNotNull())
    return top(named, n, F.asc_nulls_last("QUALITY_SCORE"), F.asc("OP_ID"))


WEEK_FIGURES = ("TIRES_BUILT", "BC_COUNT", "AC_COUNT", "SCRAP_LBS", "UNI_TESTED", "UNI_RFT")


def kpi_summary(op_week: DataFrame | None, leak_tests: DataFrame, filters: Filters = EVERYTHING, period: DataFrame | None = None) -> DataFrame:
    """One row of headline figures with their bands; empty selections give 0.

    Both inputs are stacked and summed in one aggregate. With ``period`` given, that
    leaderboard stands in (unit, crew and operator filters only) when there is no
    operator-by-week table or it is empty; figures it lacks are 0.
    """
    if period is not None and not _available(op_week):
        rows = Filters(bus=filters.bus, crews=filters.crews, op_id=filters.op_id).apply(upper_columns(period))
        weeks = rows.select(*[n for n in WEEK_FIGURES if n in rows.columns])
    elif op_week is None:
        raise ValueError("neither an operator-by-week table nor a period leaderboard is available")
    else:
        weeks = filters.apply(upper_columns(op_week)).select(*WEEK_FIGURES)
    weeks = weeks.withColumns({n: F.lit(0).cast("long") for n in WEEK_FIGURES if n not in weeks.columns})
    leaks = filters.apply(with_text_ids(leak_tests)).select(
        F.lit(1).cast("long").alias("VERIFIED"), F.col("IS_LEAK").cast("long").alias("LEAKS")
    )
    measures = {
        "TIRES_BUILT": AMOUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT, "SCRAP_LBS": AMOUNT,
        "UNI_TESTED": COUNT, "UNI_RFT": COUNT, "VERIFIED": COUNT, "LEAKS": COUNT,
    }
    sums_row = stack([weeks, leaks]).agg(*sums(measures))
    tires = F.col("TIRES_BUILT")
    figures = sums_row.withColumns(
        {
            "BC_PCT": ratio_or_zero(F.col("BC_COUNT"), tires, None),
            "AC_PCT": ratio_or_zero(F.col("AC_COUNT"), tires, None),
            "RFT_PCT": ratio_or_zero(F.col("UNI_RFT"), F.col("UNI_TESTED"), None),
            "LEAK_PCT": ratio_or_zero(F.col("LEAKS"), F.col("VERIFIED"), None),
            "SCRAP_PER_TIRE": ratio_or_zero(F.col("SCRAP_LBS"), tires, None, scale=1.0),
        }
    )
    return figures.withColumns(
        {
            "LEAK_BAND": band(F.col("LEAK_PCT"), *LEAK_BAND),
            "BC_BAND": band(F.col("BC_PCT"), *BEFORE_CURE_BAND),
            "AC_BAND": band(F.col("AC_PCT"), *AFTER_CURE_BAND),
            "RFT_BAND": band(F.col("RFT_PCT"), *RFT_BAND, low_is_good=False),
            "RFT_ON_TARGET": F.col("RFT_PCT") >= RFT_TARGET,
            "LEAK_ALERT": F.col("LEAK_PCT") > LEAK_ALERT,
        }
    )


def _sets_of_totals(df: DataFrame, names: Sequence[str], value: str, tagged: Column) -> DataFrame:
    """Totals of each category of each column, and apart by ``tagged``, in one aggregate:
    _at is the place of the column, _category its value."""
    text = df.select(*[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(names)], tagged.alias("_tagged"), F.col(value).alias("_value"))
    keys = [f"_c{i}" for i in range(len(names))]
    sets = text.groupingSets([("_tagged", key) for key in keys], "_tagged", *keys).agg(
        F.sum("_value").alias("VALUE"), *[F.grouping(key).alias(f"_g{i}") for i, key in enumerate(keys)],
    )
    at = reduce(lambda chain, i: chain.when(F.col(f"_g{i}") == 0, i), range(1, len(keys)), F.when(F.col("_g0") == 0, 0))
    return sets.select("_tagged", at.alias("_at"), F.coalesce(*keys).alias("_category"), "VALUE")


def category_totals(df: DataFrame, candidates: Sequence[str], value: str, k: int = 6, tagged: Column | None = None) -> DataFrame:
    """Totals by the first candidate column with at least two categories (else the first
    with any), the k largest and the remainder. Only ``tagged`` rows count, but all of them
    if there are none.

    One aggregate gives a row per column and category; which column, which rows and which
    categories is read off these few rows by windows. Two different categories exist
    exactly when smallest and largest differ.
    """
    names = [c for c in candidates if c in df.columns]
    totals = _sets_of_totals(df, names, value, F.lit(True) if tagged is None else tagged)
    every, column = Window.partitionBy(), Window.partitionBy("_at")
    counted = totals.withColumn("_any", F.max("_tagged").over(every)).where(F.col("_tagged") == F.col("_any"))
    edges = counted.withColumns({"_lo": F.min("_category").over(column), "_hi": F.max("_category").over(column)})
    # A column with two categories comes before all that have one.
    preference = F.when(F.col("_lo") != F.col("_hi"), F.col("_at")).when(F.col("_lo").isNotNull(), F.col("_at") + len(names))
    chosen = edges.withColumn("_preference", preference).withColumn("_best", F.min("_preference").over(every))
    chosen = chosen.where((F.col("_preference") == F.col("_best")) & F.col("_category").isNotNull())
    place = F.row_number().over(every.orderBy(F.desc_nulls_last("VALUE"), F.asc("_category")))
    placed = chosen.withColumn("IS_OTHER", place > k)
    shown = placed.groupBy(F.when(F.col("IS_OTHER"), "Other").otherwise(F.col("_category")).alias("LABEL"), "IS_OTHER").agg(F.sum("VALUE").alias("VALUE"))
    return shown.where(~F.col("IS_OTHER") | (F.col("VALUE") > 0))


def breakdown(donut: DataFrame, step: str, stage: str, filters: Filters = EVERYTHING, k: int = 6) -> DataFrame:
    """Event breakdown of one stage ('bc' or 'ac') for a production step.

    Tagged events of the step, or all if none is tagged; after-cure events of
    the second step always count in full. The operator filter does not apply.
    """
    rows = filters.apply(upper_columns(donut), known_bu_only=True)
    split = not (stage == "ac" and step == "2") and "CQ_RELATES_TO" in rows.columns
    return category_totals(rows, BREAKDOWN_COLUMNS, "CQ_COUNT", k, matches_step(STEPS[step]) if split else None)


def _week_order(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(n) for n in names])


def weekly_trend(op_week: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    """Weekly percentages for the selection, from the operator-by-week table."""
    weeks = filters.apply(upper_columns(op_week)).groupBy(*WEEK_KEYS).agg(
        total(F.col("TIRES_BUILT")).alias("TIRES"),
        total_count(F.col("BC_COUNT")).alias("BC"),
        total_count(F.col("AC_COUNT")).alias("AC"),
        total_count(F.col("UNI_TESTED")).alias("UT"),
        total_count(F.col("UNI_RFT")).alias("UR"),
    )
    return _week_order(
        weeks.withColumns(
            {
                "BC_PCT": ratio(F.col("BC"), F.col("TIRES")),
                "AC_PCT": ratio(F.col("AC"), F.col("TIRES")),
                "RFT_PCT": ratio(F.col("UR"), F.col("UT"), 2),
                "WK": short_week_label(F.col("PROD_WEEK")),
            }
        ),
        *WEEK_KEYS,
    )


def weekly_trend_from_periods(trend: DataFrame, uniformity: DataFrame | None, filters: Filters = EVERYTHING) -> DataFrame:
    """The same trend from the period aggregates, which know no crew.

    Without a unit filter the overall rows are used (all rows if there are none).
    """
    trend = upper_columns(trend)
    if filters.bus:
        rows = Filters(bus=filters.bus).apply(trend)
    else:
        any_overall = trend.agg(F.coalesce(F.max(F.col("BU") == "ALL"), F.lit(False))).scalar()
        rows = trend.where((F.col("BU") == "ALL") | ~any_overall)
    rows = Filters(weeks=filters.weeks, years=filters.years).apply(rows)
    base = rows.select(
        *WEEK_KEYS, F.col("TIRES_BUILT").alias("TIRES"), F.col("BC_COUNT").alias("BC"), F.col("AC_COUNT").alias("AC")
    )
    measures = {"TIRES": AMOUNT, "BC": COUNT, "AC": COUNT, "R": COUNT, "T": COUNT}
    others = []
    if uniformity is not None:
        tests = Filters(bus=filters.bus, weeks=filters.weeks, years=filters.years).apply(upper_columns(uniformity))
        others.append(tests.select(*WEEK_KEYS, F.col("RFT_COUNT").alias("R"), F.col("TIRES_TESTED").alias("T")))
    else:
        base = base.withColumns({"R": F.lit(0).cast("long"), "T": F.lit(0).cast("long")})
    weeks = combine_onto(base, others, WEEK_KEYS, measures)
    return _week_order(
        weeks.select(
            *WEEK_KEYS, "TIRES", "BC", "AC",
            ratio(F.col("BC"), F.col("TIRES")).alias("BC_PCT"),
            ratio(F.col("AC"), F.col("TIRES")).alias("AC_PCT"),
            ratio(F.col("R"), F.col("T"), 2).alias("RFT_PCT"),
            short_week_label(F.col("PROD_WEEK")).alias("WK"),
        ),
        *WEEK_KEYS,
    )


def trend(op_week: DataFrame | None, periods: DataFrame | None, uniformity: DataFrame | None = None, filters: Filters = EVERYTHING) -> DataFrame:
    """The weekly trend from the operator-by-week table, or from the period aggregates
    when that table is missing or empty."""
    if _available(op_week):
        return weekly_trend(op_week, filters)
    if periods is None:
        raise ValueError("neither an operator-by-week table nor a weekly trend is available")
    return weekly_trend_from_periods(periods, uniformity, filters)


def leak_kpis(leak_tests: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    tests = filters.apply(with_text_ids(leak_tests))
    counts = tests.agg(F.count(F.lit(1)).alias("TESTED"), total_count(F.col("IS_LEAK")).alias("LEAKS"))
    share = ratio_or_zero(F.col("LEAKS"), F.col("TESTED"), None)
    return counts.withColumns(
        {"OK": F.col("TESTED") - F.col("LEAKS"), "LEAK_PCT": share, "LEAK_ALERT": share > LEAK_ALERT}
    )


def leaks_by(leak_tests: DataFrame, column: str, filters: Filters = EVERYTHING, n: int | None = 10) -> DataFrame:
    """Leaks per station or shift, most first; a missing key is left out."""
    leaks = filters.apply(with_text_ids(leak_tests)).where((F.col("IS_LEAK") == 1) & F.col(column).isNotNull())
    counts = leaks.groupBy(column).agg(F.count(F.lit(1)).alias("LEAKS"))
    order = (F.desc("LEAKS"), F.asc(column))
    return counts.orderBy(*order) if n is None else top(counts, n, *order)


def leak_trend(leak_tests: DataFrame, filters: Filters = EVERYTHING) -> DataFrame:
    weeks = filters.apply(with_text_ids(leak_tests)).groupBy("YEAR", "WEEK").agg(
        F.count(F.lit(1)).alias("TESTED"), total_count(F.col("IS_LEAK")).alias("LEAKS")
    )
    labelled = weeks.withColumns(
        {"LEAK_PCT": ratio(F.col("LEAKS"), F.col("TESTED")), "WK": short_week_label(F.col("WEEK"))}
    )
    return _week_order(labelled, "YEAR", "WEEK")


def leak_worst(leak_tests: DataFrame, filters: Filters = EVERYTHING, min_tests: int = 30, n: int = 10) -> DataFrame:
    """Highest leak rates among operators with enough tests; the id stands in
    for a missing name."""
    tests = filters.apply(with_text_ids(leak_tests))
    rates = tests.groupBy("OP_ID", "OPERATOR_NAME").agg(
        F.count(F.lit(1)).alias("TESTED"), total_count(F.col("IS_LEAK")).alias("LEAKS")
    )
    enough = rates.where(F.col("TESTED") >= min_tests).withColumns(
        {
            "LEAK_PCT": ratio(F.col("LEAKS"), F.col("TESTED"), None),
            "LABEL": F.coalesce(F.col("OPERATOR_NAME"), F.col("OP_ID")),
        }
    )
    return top(enough, n, F.desc("LEAK_PCT"), F.asc("OP_ID"), F.asc_nulls_last("OPERATOR_NAME"))


def _options(df: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    df = upper_columns(df)
    entries = []
    for option, (name, whole) in columns.items():
        if name in df.columns:
            value = F.col(name).try_cast("int") if whole else F.col(name)
            entries.append(F.struct(F.lit(option).alias("OPTION"), value.cast("string").alias("VALUE")))
    return df.select(F.explode(F.array(*entries)).alias("_o")).select("_o.*").where(F.col("VALUE").isNotNull())


def filter_options(leaderboards: Sequence[DataFrame], op_weeks: Sequence[DataFrame], trends: Sequence[DataFrame], leak_tests: DataFrame | None) -> DataFrame:
    """Distinct values every filter offers, united over the tables that have them.

    Crews and weeks that are no whole numbers are skipped.
    """
    bu, crew, week = ("BU", False), ("CREW", True), ("PROD_WEEK", True)
    parts = [_options(d, {"BU": bu, "CREW": crew}) for d in leaderboards]
    parts += [_options(d, {"BU": bu, "CREW": crew, "WEEK": week}) for d in op_weeks]
    parts += [_options(d, {"WEEK": week}) for d in trends]
    if leak_tests is not None:
        parts.append(_options(leak_tests, {"WEEK": ("WEEK", True)}))
    distinct = stack(parts).distinct()
    return distinct.orderBy("OPTION", F.asc_nulls_last(F.col("VALUE").try_cast("int")), "VALUE")


def name_lookup(*tables: DataFrame) -> DataFrame:
    """Operator id to name; where tables disagree the last one wins."""
    def names(priority: int, df: DataFrame) -> DataFrame:
        known = with_text_ids(df).where(F.col("OPERATOR_NAME").isNotNull() & F.col("OP_ID").isNotNull())
        return known.select("OP_ID", "OPERATOR_NAME", F.lit(-priority).alias("_order")).distinct()

    ranked = stack([names(i, d) for i, d in enumerate(tables)])
    best: Column = F.min(F.struct("_order", "OPERATOR_NAME"))["OPERATOR_NAME"]
    return ranked.groupBy("OP_ID").agg(best.alias("OPERATOR_NAME"))
