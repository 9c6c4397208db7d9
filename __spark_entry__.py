
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import cached_property, lru_cache

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracle
from opquality.functions.dates import calendar_parts, short_week_label, to_datetime, week_label
from opquality.functions.ids import canonical_codes, normalized_ids
from opquality.functions.numbers import half_even
from opquality.operators.filters import CONFECTION, Filters, of_step_or_all
from opquality.operators.sharing import new_folder
from opquality.plans import aggregates as agg
from opquality.plans import factboard, log
from opquality.plans import scorecard as card
from opquality.plans.star import Star
from opquality.sources.buckets import write_bucketed
from opquality.sources.profile import fact_diagnostics, profile, value_counts
from opquality.sources.samples import sample_catalog
from opquality.sources.writers import json_records

try:  # the corpus operators are an optional part
    import corpus_pipeline
    from opquality.llm import queries as corpus
except ImportError:
    corpus = None

SELECTION = Filters(bus=("EUROPE", "ASIA", "AFRICA"), crews=(1, 2, 3), weeks=tuple(range(5, 31)))
UNIT_AND_WEEK = Filters(bus=("EUROPE",), weeks=tuple(range(1, 27)))
ONE_OPERATOR = Filters(op_id="000018")
LEAK_SELECTION = Filters(bus=("EUROPE", "ASIA"), crews=(1, 2), weeks=(1, 2, 3))
MIN_DATE = "2001-01-01"

TEXT = T.StringType()
LEAK_SCHEMA = "OP_ID string, BU string, CREW int, WEEK int, IS_LEAK int"


class Board:
    """The star over one folder of driver tables and the aggregates above it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.catalog = sample_catalog(spark, sf_dir)
        # The sample dates are older than the default minimum date.
        self.star = Star(self.catalog, min_date=None)

    def read(self, name: str) -> DataFrame:
        return self.catalog.read(name)

    @cached_property
    def facts(self) -> tuple[DataFrame, ...]:
        s = self.star
        return s.fact_first_step, s.fact_conf_bc, s.fact_conf_ac, s.fact_nc_scrap

    @cached_property
    def facts_fin(self) -> tuple[DataFrame, ...]:
        s = self.star
        return s.fact_second_step, s.fact_conf_bc, s.fact_conf_ac, s.fact_nc_scrap, s.fact_uniformity

    @cached_property
    def op_week(self) -> DataFrame:
        return agg.agg_op_week(*self.facts, self.star.fact_uniformity)

    @cached_property
    def op_week_fin(self) -> DataFrame:
        return agg.agg_op_week_fin(*self.facts_fin)

    @cached_property
    def leaderboard_operators(self) -> tuple[DataFrame, ...]:
        return agg.leaderboard_operators(self.facts[0], finishing=False), agg.leaderboard_operators(self.facts_fin[0], finishing=True)

    def op_week_values(self, column: str) -> list[DataFrame]:
        first = agg.operator_week_values(*self.facts, self.star.fact_uniformity, column, finishing=False)
        return [first, agg.operator_week_values(*self.facts_fin, column, finishing=True)]

    @cached_property
    def kpi(self) -> DataFrame:
        return agg.agg_kpi_summary(*self.facts)

    @cached_property
    def trend(self) -> DataFrame:
        return agg.agg_weekly_trend(self.kpi)

    @cached_property
    def trend_fin(self) -> DataFrame:
        return agg.agg_weekly_trend_fin(*self.facts_fin[:3])

    @cached_property
    def leak_tests(self) -> DataFrame:
        return self.read("fact_counter_verifier")

    def uniformity(self, step: str) -> DataFrame:
        return agg.agg_uniformity(self.read("uniformity_breakdown"), self.star.operators, step)

    @cached_property
    def clean_rows(self) -> DataFrame:
        return log.clean_log(self.read("BC_Cage_Log"), "DATE_REMOVED", carry=["LINE_NO"])

    def saved_log(self) -> DataFrame:
        return log.add_row_id(self.clean_rows, ["LINE_NO"]).drop("LINE_NO")


@lru_cache(maxsize=8)
def board(spark: SparkSession, sf_dir: str) -> Board:
    return Board(spark, sf_dir.rstrip("/"))


# Inputs that exercise the id, code and date forms on every row of a table.
RAW_IDS = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN s || '.0' WHEN 2 THEN '  ' || s || ' ' WHEN 3 THEN '-' || s WHEN 4 THEN s || '.7'
       WHEN 5 THEN s || 'e1' WHEN 6 THEN 'op' || s WHEN 7 THEN '98765432109876543210' || lpad(s, 3, '0') || '.0' ELSE '00000000' || s END AS OP_ID
FROM (SELECT l_orderkey, l_linenumber, cast(l_suppkey AS string) AS s FROM {lineitem}) AS ids"""
RAW_CODES = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN s || '.50' WHEN 2 THEN s || '.0' WHEN 3 THEN ' X' || s WHEN 4 THEN s || 'e2' WHEN 7 THEN s || CASE WHEN l_suppkey % 2 = 0 THEN 'e28' ELSE 'e-20' END
       WHEN 5 THEN s || '000000.250' WHEN 6 THEN '' END AS CQ_CODE
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, cast(l_partkey AS string) AS s FROM {lineitem}) AS codes"""
RAW_DATES = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no date ' || o_orderpriority ELSE cast(o_orderdate AS string) END AS PROD_DATE FROM {orders}"""
JSON_ROWS = """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN cast('NaN' AS double) ELSE o_totalprice END AS o_totalprice,
       o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders}"""
INSERTS = """
SELECT s_suppkey AS seq, 'N' || cast(s_suppkey AS string) AS RACK_ID, ' ' AS QUANTITY, s_name AS DISPOSITION,
       CASE WHEN s_acctbal > 5000 THEN cast(s_nationkey AS string) WHEN s_acctbal > 0 THEN '  ' END AS DATE_REMOVED
FROM {supplier}"""
UPDATES = """
SELECT c_custkey AS seq, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' || cast(c_custkey AS string)
                              ELSE cast(cast(floor(c_custkey * 2.5) AS bigint) AS string) || '.0' END AS row_id,
       'U' || cast(c_custkey AS string) AS RACK_ID, cast(c_nationkey AS string) AS QUANTITY,
       CASE WHEN c_acctbal > 0 THEN cast(c_nationkey AS string) ELSE '' END AS DATE_REMOVED
FROM {customer}
UNION ALL
SELECT -c_custkey AS seq, cast(c_custkey AS string) AS row_id, 'V' || cast(c_custkey AS string) AS RACK_ID, NULL AS QUANTITY, NULL AS DATE_REMOVED FROM {customer}"""


def _raw(b: Board, sql: str) -> DataFrame:
    names = {n: b.read(n) for n in ("lineitem", "orders", "supplier", "customer") if "{" + n + "}" in sql}
    return b.catalog.spark.sql(sql, **names)


def _code_form(b: Board) -> DataFrame:
    return canonical_codes(_raw(b, RAW_CODES)).drop("CQ_CODE")


def _date_parts(b: Board) -> DataFrame:
    stamp = to_datetime(F.col("PROD_DATE"), TEXT)
    return _raw(b, RAW_DATES).select("o_orderkey", stamp.alias("PROD_DATE")).withColumns(
        calendar_parts(F.col("PROD_DATE"), day_of_week=True)
    )


def _week_labels(b: Board) -> DataFrame:
    weeks = _date_parts(b).groupBy("PROD_YEAR", "PROD_WEEK").agg(F.count(F.lit(1)).alias("N"))
    return weeks.withColumns(
        {"WEEK_LABEL": week_label(F.col("PROD_YEAR"), F.col("PROD_WEEK")), "WK": short_week_label(F.col("PROD_WEEK"))}
    )


def _profile(b: Board) -> DataFrame:
    """Cut to decimals that do not depend on the order of addition."""
    digits = {"MEAN": 4, "STD": 4, "Q25": 6, "Q50": 6, "Q75": 6}
    return profile(b.read("lineitem")).withColumns({name: half_even(F.col(name), d) for name, d in digits.items()})


def _diagnostics(b: Board) -> DataFrame:
    return fact_diagnostics(b.star.fact_uniformity).withColumns(
        {"IS_RFT_MEAN": half_even(F.col("IS_RFT_MEAN"), 6), "IS_REPAIRED_MEAN": half_even(F.col("IS_REPAIRED_MEAN"), 6)}
    )


def _json(b: Board) -> DataFrame:
    """Whole rows; prices of some and priorities of others are missing."""
    return json_records(_raw(b, JSON_ROWS))


def _uniformity_bucketed(b: Board) -> DataFrame:
    """From tests stored in buckets of the barcode."""
    path = new_folder(b.catalog.spark, "tests")
    tests = write_bucketed(agg.test_columns(b.read("uniformity_breakdown")), path, "BARCODE", buckets=16)
    return agg.agg_uniformity(tests, b.star.operators, CONFECTION, by_barcode=True)


def _saved_log(b: Board) -> DataFrame:
    """The change set of apply_changes saved in three steps, with a new base in between."""
    spark, path = b.catalog.spark, new_folder(b.catalog.spark, "log")
    updates = _raw(b, UPDATES)
    log.save_changes(spark, path, b.saved_log(), _raw(b, INSERTS), updates.where("seq <= 0"), date_removed="DATE_REMOVED")
    log.compact(spark, path)
    log.save_changes(spark, path, b.saved_log(), None, updates.where("seq > 0"), date_removed="DATE_REMOVED")
    return log.load_log(spark, path, b.saved_log())


def _fallback(b: Board) -> DataFrame:
    """No event is tagged with this step, so all of them are kept."""
    cells = of_step_or_all(b.star.fact_conf_bc, "Curing")
    return cells.groupBy("CQ_RELATES_TO").agg(F.count(F.lit(1)).alias("N"))


def _name_lookup(b: Board) -> DataFrame:
    """From the operators of the tables, without their figures."""
    return card.name_lookup(*b.leaderboard_operators, *b.op_week_values("OP_ID"))


def _filter_options(b: Board) -> DataFrame:
    """From the operators and weeks of the tables, without their figures."""
    op_weeks = [*b.op_week_values("OP_ID"), *b.op_week_values("PROD_WEEK")]
    return card.filter_options(b.leaderboard_operators, op_weeks, [b.trend, b.trend_fin], b.leak_tests)


REGISTERED: dict[str, Callable[[Board], DataFrame]] = {
    "norm_id_numeric": lambda b: normalized_ids(_raw(b, RAW_IDS)),
    "norm_id_text": lambda b: normalized_ids(_raw(b, RAW_IDS), mode="text"),
    "cq_code_form": _code_form,
    "date_parts": _date_parts,
    "week_label": _week_labels,
    "dim_operator": lambda b: b.star.dim_operator,
    "fact_first_step": lambda b: b.star.fact_first_step,
    "fact_first_step_since": lambda b: Star(b.catalog, min_date=MIN_DATE).fact_first_step,
    "fact_second_step": lambda b: b.star.fact_second_step,
    "fact_conf_bc": lambda b: b.star.fact_conf_bc,
    "fact_conf_ac": lambda b: b.star.fact_conf_ac,
    "fact_nc_scrap": lambda b: b.star.fact_nc_scrap,
    "fact_uniformity": lambda b: b.star.fact_uniformity,
    "agg_kpi_summary": lambda b: b.kpi,
    "agg_donut_bc": lambda b: agg.agg_donut(b.star.fact_conf_bc),
    "agg_donut_ac": lambda b: agg.agg_donut(b.star.fact_conf_ac),
    "agg_donut_scrap": lambda b: agg.agg_donut_scrap(b.star.fact_nc_scrap),
    "agg_top_performers": lambda b: agg.agg_top_performers(*b.facts),
    "agg_top_performers_fin": lambda b: agg.agg_top_performers_fin(*b.facts_fin),
    "agg_uniformity": lambda b: b.uniformity(CONFECTION),
    "agg_uniformity_bucketed": _uniformity_bucketed,
    "agg_uniformity_fin": lambda b: b.uniformity("Finishing"),
    "agg_op_week": lambda b: b.op_week,
    "agg_op_week_fin": lambda b: b.op_week_fin,
    "agg_weekly_trend": lambda b: b.trend,
    "agg_weekly_trend_fin": lambda b: b.trend_fin,
    "op_rollup_all": lambda b: card.op_rollup(b.op_week),
    "op_rollup_fin": lambda b: card.op_rollup(b.op_week_fin),
    "op_rollup_filtered": lambda b: card.op_rollup(b.op_week, SELECTION),
    "op_rollup_operator": lambda b: card.op_rollup(b.op_week, ONE_OPERATOR),
    "kpi_banded": lambda b: card.kpi_summary(b.op_week, b.leak_tests),
    "kpi_banded_filtered": lambda b: card.kpi_summary(b.op_week_fin, b.leak_tests, UNIT_AND_WEEK),
    "kpi_period": lambda b: card.kpi_summary(b.op_week.limit(0), b.leak_tests, UNIT_AND_WEEK, period=agg.agg_top_performers(*b.facts)),
    "breakdown_bc": lambda b: card.breakdown(agg.donut_cells(b.star.fact_conf_bc), "1", "bc"),
    "breakdown_ac": lambda b: card.breakdown(agg.donut_cells(b.star.fact_conf_ac), "2", "ac", SELECTION),
    "breakdown_codes": lambda b: card.category_totals(agg.donut_cells(b.star.fact_conf_bc), ["CQ_CODE_STR"], "CQ_COUNT"),
    "step_filter_fallback": _fallback,
    "trend_live": lambda b: card.weekly_trend(b.op_week, SELECTION),
    "trend_with_rft": lambda b: card.weekly_trend_from_periods(b.trend, b.uniformity(CONFECTION), UNIT_AND_WEEK),
    "trend_with_rft_all": lambda b: card.weekly_trend_from_periods(b.trend_fin, b.uniformity("Finishing")),
    "trend_fallback": lambda b: card.trend(None, b.trend, b.uniformity(CONFECTION), UNIT_AND_WEEK),
    "quality_top": lambda b: card.quality_top(card.op_rollup(b.op_week)),
    "scrap_top": lambda b: card.scrap_top(card.op_rollup(b.op_week, SELECTION)),
    "rankings": lambda b: card.rankings(card.op_rollup(b.op_week_fin), 15),
    "leak_kpis": lambda b: card.leak_kpis(b.leak_tests),
    "leak_stations": lambda b: card.leaks_by(b.leak_tests, "COUNTER_VERIFIER_ID", LEAK_SELECTION),
    "leak_shifts": lambda b: card.leaks_by(b.leak_tests, "SHIFT", n=None),
    "leak_trend": lambda b: card.leak_trend(b.leak_tests),
    "leak_trend_filtered": lambda b: card.leak_trend(b.leak_tests, LEAK_SELECTION),
    "leak_kpis_filtered": lambda b: card.leak_kpis(b.leak_tests, LEAK_SELECTION),
    "leak_worst": lambda b: card.leak_worst(b.leak_tests),
    "leak_trend_by_id": lambda b: factboard.leak_trend_by_id(b.leak_tests),
    "leak_worst_known": lambda b: factboard.leak_worst_known(b.leak_tests),
    "fact_kpis": lambda b: factboard.fact_kpis(*b.facts, SELECTION),
    "fact_donut_bc": lambda b: factboard.event_donut(b.star.fact_conf_bc),
    "fact_donut_ac": lambda b: factboard.event_donut(b.star.fact_conf_ac, SELECTION),
    "fact_donut_scrap": lambda b: factboard.scrap_donut(b.star.fact_nc_scrap),
    "fact_trend": lambda b: factboard.fact_trend(*b.facts, UNIT_AND_WEEK),
    "period_best": lambda b: factboard.period_best(agg.agg_top_performers(*b.facts), Filters(bus=("EUROPE", "ASIA"))),
    "filter_options": _filter_options,
    "name_lookup": _name_lookup,
    "read_columns": lambda b: b.catalog.read("first_step_prod", ["OP_ID", "TIRES_BUILT", "NOT_THERE"]),
    "read_first_nonempty": lambda b: b.catalog.read_first_nonempty("log_not_there", "BC_Cage_Log")[0],
    "kpi_without_leak_tests": lambda b: card.kpi_summary(b.op_week, b.catalog.read_or_empty("leak_tests_not_there", LEAK_SCHEMA)),
    "clean_log": lambda b: log.clean_log(b.read("BC_Cage_Log").drop("LINE_NO"), "DATE_REMOVED"),
    "clean_report": lambda b: log.clean_report(b.read("BC_Cage_Log"), "DATE_REMOVED", carry=["LINE_NO"]),
    "log_row_id": lambda b: b.saved_log(),
    "grid_filter": lambda b: log.grid_query(b.saved_log(), {"DISPOSITION": "1-URGENT", "QUANTITY": "1"}, sort="QUANTITY", exact=("DISPOSITION",)),
    "grid_search": lambda b: log.grid_query(b.saved_log(), {"Status": "Closed"}, search="r1", sort="RACK_ID"),
    "grid_sort": lambda b: log.grid_query(b.saved_log(), sort="RACK_ID", descending=True),
    "grid_counts": lambda b: log.grid_counts(b.saved_log(), {"DISPOSITION": "1-URGENT", "QUANTITY": "1"}, exact=("DISPOSITION",)),
    "suggestions": lambda b: log.suggestions(b.clean_rows.drop("LINE_NO")),
    "apply_changes": lambda b: log.apply_changes(b.saved_log(), _raw(b, INSERTS), _raw(b, UPDATES), date_removed="DATE_REMOVED"),
    "log_saved": _saved_log,
    "profile_table": _profile,
    "fact_diagnostics": _diagnostics,
    "value_counts": lambda b: value_counts(b.star.fact_uniformity, "UNI_GRADE"),
    "json_export": _json,
}


def entry(spark: SparkSession) -> DataFrame:
    """Best operators of the first step, from raw tables to ranked scores."""
    return queries()["quality_top"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, build=build: build(board(spark, sf_dir))) for name, build in REGISTERED.items()}
    if corpus is not None:
        found |= corpus.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    known = oracle.statements()
    if corpus is not None:
        known |= corpus.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return known
