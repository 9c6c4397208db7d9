"""The published aggregates, each from fact tables to its own grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opquality.functions.dates import to_datetime, week_label
from opquality.functions.ids import normalized_ids
from opquality.functions.numbers import number_or_zero, ratio, total, total_count
from opquality.operators.filters import CONFECTION, FINISHING, of_step, with_code
from opquality.operators.lookup import Lookup, first_of_bucketed, first_per_key
from opquality.operators.measures import AMOUNT, COUNT, combine, combine_onto, dealt, stack, sums, best_per_item, with_share_of_total
from opquality.operators.scoring import scored_and_ranked
from opquality.operators.sharing import written
from opquality.plans.star import repair_flag, rft_flag
from opquality.sources.columns import column_type, upper_columns

WEEK_KEYS = ("PROD_YEAR", "PROD_WEEK")
CELL_KEYS = ("BU", "CREW", *WEEK_KEYS)
OPERATOR_WEEK_KEYS = ("OP_ID", *WEEK_KEYS)
CODE_KEYS = ("CQ_CODE_STR", "CQ_DESCRIPTION", "CQ_RELATES_TO", "CQ_TYPE_TIER")
BASE_KEYS = ("OP_ID", "OPERATOR_NAME", "BU", "CREW", "SUPERVISOR_CHORUS_ID")
SCRAP = "OP_SCRAP_LBS_BY_TIRES"


def _renormalized(df: DataFrame, mode: str) -> DataFrame:
    return normalized_ids(upper_columns(df), mode=mode)


def _events(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """One count per event that has a code."""
    return with_code(df).select(*keys, F.lit(1).cast("long").alias(name))


def _amounts(df: DataFrame, keys: tuple[str, ...], **amounts: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(n) for n, c in amounts.items()])


def percentages(rft: bool = False) -> dict[str, Column]:
    """Defects and scrap per tire built (and right-first-time per tire tested)."""
    tires = F.col("TIRES_BUILT")
    columns = {
        "BC_PCT": ratio(F.col("BC_COUNT"), tires),
        "AC_PCT": ratio(F.col("AC_COUNT"), tires),
        "SCRAP_PCT": ratio(F.col("SCRAP_LBS"), tires, scale=1.0),
    }
    if rft:
        columns["RFT_PCT"] = ratio(F.col("UNI_RFT"), F.col("UNI_TESTED"))
    return columns


def agg_kpi_summary(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame) -> DataFrame:
    """Week totals per unit and crew; events in cells without production are lost."""
    prod, bc, ac, scrap = map(upper_columns, (prod, bc, ac, scrap))
    per_operator = prod.groupBy(*CELL_KEYS, "OP_ID").agg(F.sum(F.col("TIRES_BUILT").cast("double")).alias("TIRES_BUILT"))
    base = per_operator.select(
        *CELL_KEYS, "TIRES_BUILT", F.col("OP_ID").isNotNull().cast("long").alias("OPERATORS")
    )
    others = [
        _events(bc, CELL_KEYS, "BC_COUNT"),
        _events(ac, CELL_KEYS, "AC_COUNT"),
        _amounts(scrap, CELL_KEYS, SCRAP_LBS=SCRAP, SCRAP_TIRES="OP_TIRES"),
    ]
    measures = {
        "TIRES_BUILT": AMOUNT, "OPERATORS": COUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT,
        "SCRAP_LBS": AMOUNT, "SCRAP_TIRES": AMOUNT,
    }
    return combine_onto(base, others, CELL_KEYS, measures).withColumns(percentages())


def donut_cells(events: DataFrame) -> DataFrame:
    """Events per unit, crew, week and code; missing parts are groups of their own."""
    return with_code(upper_columns(events)).groupBy(*CELL_KEYS, *CODE_KEYS).agg(F.count(F.lit(1)).alias("CQ_COUNT"))


def agg_donut(events: DataFrame) -> DataFrame:
    """Event cells with their share of all events of the unit and crew.

    The share divides a week's count by the total of all weeks.
    """
    keys = [*CELL_KEYS, *CODE_KEYS]
    slices = with_share_of_total(written(donut_cells(events), "donut"), "CQ_COUNT", total_count, ["BU", "CREW"], "BU_CREW_TOTAL", "PCT_OF_SLICE")
    return slices.orderBy(F.desc("CQ_COUNT"), *keys)


def agg_donut_scrap(scrap: DataFrame) -> DataFrame:
    """Scrap per unit, crew, week and machine, with its share of unit and crew."""
    keys = [*CELL_KEYS, "TBM"]
    cells = upper_columns(scrap).groupBy(*keys).agg(
        total(F.col(SCRAP)).alias("SCRAP_LBS"),
        total(F.col("OP_TIRES")).alias("TIRES"),
        F.count("OP_ID").alias("EVENTS"),
    )
    cells = written(cells.withColumn("LBS_PER_TIRE", ratio(F.col("SCRAP_LBS"), F.col("TIRES"), scale=1.0)), "donut")
    slices = with_share_of_total(cells, "SCRAP_LBS", total, ["BU", "CREW"], "BU_CREW_TOTAL", "PCT_OF_SLICE")
    return slices.orderBy(F.desc_nulls_last("SCRAP_LBS"), *keys)


def _leaderboard(prod: DataFrame, others: list[DataFrame], measures: dict[str, str], min_tires: float, rft: bool) -> DataFrame:
    """Operator totals with percentages, score and rank.

    Distinct production dates are counted by aggregating per date first.
    """
    per_date = prod.groupBy(*BASE_KEYS, "PROD_DATE").agg(F.sum(F.col("TIRES_BUILT").cast("double")).alias("TIRES_BUILT"))
    base = per_date.groupBy(*BASE_KEYS).agg(
        total(F.col("TIRES_BUILT")).alias("TIRES_BUILT"),
        F.count("PROD_DATE").alias("SHIFTS_WORKED"),
    )
    events = combine(others, ["OP_ID"], measures)
    merged = base.join(events, "OP_ID", "left").fillna(0, subset=list(measures))
    merged = written(merged.withColumns(percentages(rft)), "leaderboard")
    terms = {name.replace("_PCT", "_NORM"): F.coalesce(F.col(name), F.lit(0.0)) for name in ("BC_PCT", "AC_PCT", "SCRAP_PCT")}
    if rft:
        terms["UNI_NORM"] = F.coalesce(100 - F.col("RFT_PCT"), F.lit(0.0))
    board = scored_and_ranked(merged, terms, min_tires)
    return board.orderBy(F.desc("RANKABLE"), F.asc("QUALITY_SCORE"), "OP_ID")


def agg_top_performers(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, min_tires: float = 100) -> DataFrame:
    """First-step leaderboard: defects and scrap per tire."""
    prod, bc, ac, scrap = (_renormalized(d, "numeric") for d in (prod, bc, ac, scrap))
    others = [
        _events(bc, ("OP_ID",), "BC_COUNT"),
        _events(ac, ("OP_ID",), "AC_COUNT"),
        _amounts(scrap, ("OP_ID",), SCRAP_LBS=SCRAP),
    ]
    measures = {"BC_COUNT": COUNT, "AC_COUNT": COUNT, "SCRAP_LBS": AMOUNT}
    return _leaderboard(prod, others, measures, min_tires, rft=False)


def _finishing_tests(uniformity: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tests credited to the finishing operator, best flag per tire."""
    tests = normalized_ids(upper_columns(uniformity), "FINISHING_OPERATOR_ID", "text")
    flag = number_or_zero(F.col("IS_RFT"), column_type(tests, "IS_RFT"))
    return best_per_item(tests.withColumn("IS_RFT", flag), keys, "BARCODE", "IS_RFT")


def _building_tests(uniformity: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tests credited to the building operator, best flag per tire."""
    tests = _renormalized(uniformity, "text")
    flag = number_or_zero(F.col("IS_RFT"), column_type(tests, "IS_RFT"))
    return best_per_item(tests.withColumn("IS_RFT", flag), keys, "BARCODE", "IS_RFT")


def agg_top_performers_fin(
    prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, uniformity: DataFrame,
    min_tires: float = 100, ac_scope: str | None = FINISHING,
) -> DataFrame:
    """Second-step leaderboard, with right-first-time as a fourth term.

    ``ac_scope`` None counts every after-cure event instead of this step's.
    """
    prod, bc, ac, scrap = (_renormalized(d, "text") for d in (prod, bc, ac, scrap))
    others = [
        _events(of_step(bc, FINISHING), ("OP_ID",), "BC_COUNT"),
        _events(of_step(ac, ac_scope), ("OP_ID",), "AC_COUNT"),
        _amounts(scrap, ("OP_ID",), SCRAP_LBS=SCRAP),
        _finishing_tests(uniformity, ("OP_ID",)),
    ]
    measures = {"BC_COUNT": COUNT, "AC_COUNT": COUNT, "SCRAP_LBS": AMOUNT, "UNI_TESTED": COUNT, "UNI_RFT": COUNT}
    return _leaderboard(prod, others, measures, min_tires, rft=True)


def _first_tests(tests: DataFrame, by_barcode: bool) -> DataFrame:
    """The first test of each barcode (missing times last, ties by the other
    columns); tests without a barcode share one row, as equal keys do."""
    if not {"BARCODE", "TEST_DATETIME"} <= set(tests.columns):
        return tests
    first = first_of_bucketed if by_barcode else first_per_key
    return first(tests, ["BARCODE"], order_by=["TEST_DATETIME"])


# What the uniformity aggregates read of a test.
TEST_COLUMNS = (
    "BARCODE", "TEST_DATETIME", "CONFECTION_OPERATOR_ID", "CONFECTION_TIMESTAMP", "FINISHING_OPERATOR_ID", "FINISHING_TIMESTAMP",
    "RUN_TYPE", "OGU2_GRADE", "UNI_GRADE", "UNI_REPAIR",
)


def test_columns(tests: DataFrame) -> DataFrame:
    """The tests with the columns that their aggregates read, as far as they exist."""
    return upper_columns(tests).select(*[c for c in TEST_COLUMNS if c in upper_columns(tests).columns])


def agg_uniformity(tests: DataFrame, operators: Lookup, step: str = FINISHING, by_barcode: bool = False) -> DataFrame:
    """First-test results per unit, crew and week of the given step's operator.

    For the finishing step each column falls back to its building counterpart
    when the source lacks it. ``by_barcode``: the tests are stored in buckets of the
    barcode (``sources/buckets.py``), so that their first needs no shuffle.
    """
    tests = upper_columns(tests)
    prefixes = ["FINISHING", "CONFECTION"] if step == FINISHING else ["CONFECTION"]
    op_column = next((f"{p}_OPERATOR_ID" for p in prefixes if f"{p}_OPERATOR_ID" in tests.columns), "CONFECTION_OPERATOR_ID")
    stamp = next((f"{p}_TIMESTAMP" for p in prefixes if f"{p}_TIMESTAMP" in tests.columns), "CONFECTION_TIMESTAMP")
    grade = next((c for c in ("OGU2_GRADE", "UNI_GRADE") if c in tests.columns), None)
    when = to_datetime(F.col(stamp), column_type(tests, stamp))
    slim = normalized_ids(tests, op_column).select(
        *[c for c in ("BARCODE", "TEST_DATETIME") if c in tests.columns],
        "OP_ID",
        rft_flag(tests, grade).alias("IS_RFT"),
        repair_flag(tests).alias("IS_REPAIR"),
        F.year(when).alias("PROD_YEAR"),
        F.weekofyear(when).alias("PROD_WEEK"),
    )
    known = operators.select("OP_ID", "BU", "CREW").left_join(_first_tests(slim, by_barcode), spread_by=("BARCODE",))
    return known.groupBy(*CELL_KEYS).agg(
        F.count_distinct("BARCODE").alias("TIRES_TESTED") if "TEST_DATETIME" not in tests.columns
        else F.count("BARCODE").alias("TIRES_TESTED"),
        total_count(F.col("IS_RFT")).alias("RFT_COUNT"),
        total_count(F.col("IS_REPAIR")).alias("REPAIR_COUNT"),
    ).withColumns(
        {
            "RFT_PCT": ratio(F.col("RFT_COUNT"), F.col("TIRES_TESTED")),
            "REPAIR_PCT": ratio(F.col("REPAIR_COUNT"), F.col("TIRES_TESTED")),
        }
    )


OPERATOR_WEEK_MEASURES = {
    "TIRES_BUILT": AMOUNT, "SHIFTS": COUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT,
    "SCRAP_LBS": AMOUNT, "UNI_TESTED": COUNT, "UNI_RFT": COUNT,
}


def agg_operator_week(
    prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, uniformity: DataFrame,
    bc_scope: str | None, ac_scope: str | None, finishing: bool,
) -> DataFrame:
    """Raw counts per operator and week, for live roll-ups.

    An operator-week present in any of the five inputs is kept; the identity
    comes from production rows that know the operator's name.
    """
    prod, bc, ac, scrap = (_renormalized(d, "text") for d in (prod, bc, ac, scrap))
    dates = dealt([prod.select(*OPERATOR_WEEK_KEYS, "PROD_DATE", "TIRES_BUILT")], [*OPERATOR_WEEK_KEYS, "PROD_DATE"])
    per_date = dates.groupBy(*OPERATOR_WEEK_KEYS, "PROD_DATE").agg(F.sum(F.col("TIRES_BUILT").cast("double")).alias("TIRES_BUILT"))
    shifts = F.col("PROD_DATE").isNotNull().cast("long").alias("SHIFTS")
    tests = _finishing_tests if finishing else _building_tests
    parts = [
        per_date.select(*OPERATOR_WEEK_KEYS, "TIRES_BUILT", shifts),
        _events(of_step(bc, bc_scope), OPERATOR_WEEK_KEYS, "BC_COUNT"),
        _events(of_step(ac, ac_scope), OPERATOR_WEEK_KEYS, "AC_COUNT"),
        _amounts(scrap, OPERATOR_WEEK_KEYS, SCRAP_LBS=SCRAP),
        tests(uniformity, OPERATOR_WEEK_KEYS),
    ]
    counts = combine(parts, OPERATOR_WEEK_KEYS, OPERATOR_WEEK_MEASURES, fine=True)
    # Once there are too many operators to broadcast, their weeks are sorted by operator to
    # find the identity, and a roll-up groups them in the same tasks.
    return _with_identity(dealt([counts], ["OP_ID"]), prod)


def _with_identity(counts: DataFrame, prod: DataFrame) -> DataFrame:
    """Name, unit and crew of each operator, from rows that carry a name, which
    sort before those that do not."""
    # Their few different rows first: the least of a group is found by sorting.
    first = first_per_key(prod.select("OP_ID", "OPERATOR_NAME", "BU", "CREW").distinct(), ["OP_ID"])
    named = F.col("OPERATOR_NAME").isNotNull()
    identity = first.select(
        "OP_ID", "OPERATOR_NAME", F.when(named, F.col("BU")).alias("BU"), F.when(named, F.col("CREW")).alias("CREW")
    )
    return counts.join(identity, "OP_ID", "left")


def operator_week_values(
    prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, uniformity: DataFrame, column: str, finishing: bool,
) -> DataFrame:
    """The different values of one key of ``agg_op_week`` or, finishing, ``agg_op_week_fin``,
    from all five inputs; operators come with their identity. Lists of names and options
    need no figures, whose groups are nearly as many as the rows."""
    prod, bc, ac, scrap = (_renormalized(d, "text") for d in (prod, bc, ac, scrap))
    tests = normalized_ids(upper_columns(uniformity), "FINISHING_OPERATOR_ID" if finishing else "OP_ID", "text")
    events = [of_step(bc, FINISHING), ac] if finishing else [of_step(bc, CONFECTION), of_step(ac, CONFECTION)]
    parts = [prod, *map(with_code, events), scrap, tests]
    values = stack([part.select(column) for part in parts]).distinct()
    return _with_identity(values, prod) if column == "OP_ID" else values


def leaderboard_operators(prod: DataFrame, finishing: bool) -> DataFrame:
    """The operators of ``agg_top_performers`` or, finishing, ``agg_top_performers_fin``,
    which are those of its production; without figures."""
    return _renormalized(prod, "text" if finishing else "numeric").select(*BASE_KEYS).distinct()


def agg_op_week(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, uniformity: DataFrame) -> DataFrame:
    return agg_operator_week(prod, bc, ac, scrap, uniformity, CONFECTION, CONFECTION, finishing=False)


def agg_op_week_fin(prod: DataFrame, bc: DataFrame, ac: DataFrame, scrap: DataFrame, uniformity: DataFrame, ac_scope: str | None = None) -> DataFrame:
    """Second step; by default every after-cure event counts."""
    return agg_operator_week(prod, bc, ac, scrap, uniformity, FINISHING, ac_scope, finishing=True)


def _overall_and_per_bu(cells: DataFrame, measures: dict[str, str], *extra: Column) -> DataFrame:
    """Sums per week for all units together (BU 'ALL') and per unit.

    grouping() tells the overall rows from those of a missing unit.
    """
    rolled = cells.groupingSets([WEEK_KEYS, ("BU", *WEEK_KEYS)], "BU", *WEEK_KEYS).agg(
        F.grouping("BU").alias("_ALL"), *sums(measures), *extra
    )
    bu = F.when(F.col("_ALL") == 1, "ALL").otherwise(F.col("BU"))
    return rolled.withColumns({"BU": bu, "CREW": F.lit("ALL")}).drop("_ALL")


def _trend_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("BU"), F.asc_nulls_last("PROD_YEAR"), F.asc_nulls_last("PROD_WEEK"))


def agg_weekly_trend(kpi_summary: DataFrame) -> DataFrame:
    """Weekly totals over the KPI cells, overall and per unit."""
    measures = {"TIRES_BUILT": AMOUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT, "SCRAP_LBS": AMOUNT}
    cells = upper_columns(kpi_summary).select("BU", *WEEK_KEYS, *measures)
    trend = _overall_and_per_bu(cells, measures).withColumns(percentages())
    return _trend_order(trend.withColumn("WEEK_LABEL", week_label(F.col("PROD_YEAR"), F.col("PROD_WEEK"))))


def agg_weekly_trend_fin(prod: DataFrame, bc: DataFrame, ac: DataFrame, ac_scope: str | None = FINISHING) -> DataFrame:
    """Second-step weekly totals, overall and per unit, for weeks with production.

    Facts are aggregated to unit and week before the grouping sets multiply rows.
    """
    prod, bc, ac = map(upper_columns, (prod, bc, ac))
    keys = ("BU", *WEEK_KEYS)
    measures = {"TIRES_BUILT": AMOUNT, "BC_COUNT": COUNT, "AC_COUNT": COUNT}
    parts = [
        _amounts(prod, keys, TIRES_BUILT="TIRES_BUILT").withColumn("_IN_BASE", F.lit(1)),
        _events(of_step(bc, FINISHING), keys, "BC_COUNT"),
        _events(of_step(ac, ac_scope), keys, "AC_COUNT"),
    ]
    in_base = F.max("_IN_BASE").alias("_IN_BASE")
    cells = stack(parts).groupBy(*keys).agg(*sums(measures), in_base)
    trend = _overall_and_per_bu(cells, measures, in_base).where(F.col("_IN_BASE") == 1).drop("_IN_BASE")
    trend = trend.withColumn("SCRAP_LBS", F.lit(0.0)).withColumns(percentages()).withColumn("SCRAP_PCT", F.lit(0.0))
    return _trend_order(trend.withColumn("WEEK_LABEL", week_label(F.col("PROD_YEAR"), F.col("PROD_WEEK"))))
