"""Star schema, aggregates and reports on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opquality.operators.filters import Filters
from opquality.plans import aggregates as agg
from opquality.plans import factboard
from opquality.plans import scorecard as card
from opquality.plans.refresh import RefreshFailed, refresh
from opquality.plans.star import Star, dim_operator, fact_second_step, operator_lookup
from opquality.operators.lookup import first_of_bucketed
from opquality.sources.buckets import read_bucketed, write_bucketed
from opquality.sources.readers import Catalog
from opquality.sources.snapshots import SnapshotConflict

D1, D2, OLD = "2026-05-04 06:00:00", "2026-05-12 06:00:00", "2026-04-01 06:00:00"
UNI = (
    "BARCODE bigint, RUN_TYPE string, OGU2_GRADE string, UNI_REPAIR string, TEST_DATETIME timestamp_ntz, "
    "CONFECTION_TIMESTAMP timestamp_ntz, FINISHING_TIMESTAMP timestamp_ntz, CONFECTION_OPERATOR_ID bigint, FINISHING_OPERATOR_ID bigint"
)


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def tables(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return {
        "view_employee": make(
            [("1.0", "C1", "Ann", "S1", "K", "B", 1), ("2", "C2", "Bob", "S1", "K", "F", 1), ("2", "C9", "Bob II", "S1", "K", "F", 0),
             ("ab", "C3", "Cy", "S2", "K", "F", 1), (None, "C4", "Nil", "S2", "K", "F", 1)],
            "op_id string, chorus_id string, operator_name string, supervisor_chorus_id string, cost_center string, position string, is_active int",
        ),
        "BU_data": make([("1", "E", 1), ("1", "W", 2), ("2", "W", 2), (None, "N", 9)], "OP_ID string, BU string, CREW int"),
        "first_step_prod": make(
            [("1", ts(D1), "T1", 60.0), ("1", ts(D1), "T2", 40.0), ("1", ts(D2), "T1", 50.0), ("2", ts(D1), "T1", 200.0),
             ("ab", ts(D1), "T1", 5.0), ("9", ts(D1), "T1", 0.0), (None, ts(D1), "T1", 7.0), ("1", ts(OLD), "T1", 900.0), ("1", None, "T1", 800.0)],
            "OP_ID string, PROD_DATE timestamp_ntz, TBM string, TIRES_BUILT double",
        ),
        "second_step_prod": make([(2.0, ts(D1), 150.0), (1.0, ts(D2), 10.0)], "FIN_OP_ID double, PROD_DATE timestamp_ntz, TOTAL_TIRES double"),
        "conf_bc_grq2": make(
            [("1.0", D1, "12.50"), ("1", D1, "12.5"), ("2", D1, " X50 "), ("2", D1, ""), ("2", D1, None), ("2", "garbage", "12.5"), ("3", D2, "7.0")],
            "OP_ID string, PROD_DATE string, CQ_CODE string",
        ),
        "conf_ac_grq2": make([("2", D1, 12.5), ("1", D2, 7.0), ("1", D2, None)], "OP_ID string, PROD_DATE string, CQ_CODE double"),
        "TBM6": make(
            [("12.50", "bulge", "Confection", "Tier 1"), ("12.5", "zz later copy", "Confection", "Tier 9"), ("X50", "cut", " finishing ", "Tier 2"), ("7", "mark", "Finishing", "Tier 1")],
            "`CQ` string, `CQ_CODE_DESCRIPTION` string, `RELATES TO` string, `TYPES` string",
        ),
        "nc_scrap": make(
            [("1", ts(D1), "T1", 3.25, 2.0), ("2", ts(D1), "T1", 1.0, 0.0), (None, ts(D1), "T2", 4.0, 1.0)],
            "OP_ID string, PROD_DATE timestamp_ntz, TBM string, OP_SCRAP_LBS_BY_TIRES double, OP_TIRES double",
        ),
        "uniformity_breakdown": make(
            [(10, "N", None, None, ts(D2), ts(D1), ts(D2), 1, 2), (10, "A", "G1", "R", ts(D1), ts(D1), ts(D2), 1, 2),
             (11, "N", None, None, ts(D2), None, ts(D2), 2, 1), (None, "N", None, None, ts(D2), ts(D1), ts(D1), 1, 2)],
            UNI,
        ),
    }


@pytest.fixture(scope="module")
def star(spark):
    return Star(Catalog(spark, tables=tables(spark)))


@pytest.fixture(scope="module")
def first_facts(star):
    return star.fact_first_step, star.fact_conf_bc, star.fact_conf_ac, star.fact_nc_scrap


def test_dimension_fans_out_and_matches_missing_ids(star, rows):
    got = rows(star.dim_operator, "OP_ID", "OPERATOR_NAME", "BU", "CREW")
    assert got == [
        ("000001", "Ann", "E", 1), ("000001", "Ann", "W", 2), ("000002", "Bob", "W", 2), ("000002", "Bob II", "W", 2),
        ("0000ab", "Cy", None, None), (None, "Nil", "N", 9),
    ]


def test_columns_of_both_sides_are_told_apart(spark):
    employees = spark.createDataFrame([("1", "x")], "OP_ID string, BU string")
    units = spark.createDataFrame([("1", "y")], "OP_ID string, BU string")
    assert dim_operator(employees, units).columns == ["OP_ID", "BU_x", "BU_y"]


def test_dimension_key_is_upper_cased_but_fact_ids_are_not(star, rows):
    got = rows(star.fact_first_step.where("OP_ID = '0000ab'"), "OPERATOR_NAME")
    assert got == [(None,)]


def test_first_step_keeps_rows_from_the_minimum_date_on(star, rows):
    got = rows(star.fact_first_step, "OP_ID", "TBM", "TIRES_BUILT", "BU", "PROD_YEAR", "PROD_WEEK", "PROD_DOW")
    assert got == [
        ("000001", "T1", 50.0, "E", 2026, 20, 1), ("000001", "T1", 60.0, "E", 2026, 19, 0), ("000001", "T2", 40.0, "E", 2026, 19, 0),
        ("000002", "T1", 200.0, "W", 2026, 19, 0), ("000009", "T1", 0.0, None, 2026, 19, 0), ("0000ab", "T1", 5.0, None, 2026, 19, 0),
        (None, "T1", 7.0, None, 2026, 19, 0),
    ]


def test_second_step_finds_its_columns_or_says_what_there_is(spark, star):
    fact = star.fact_second_step
    assert {"FIN_OP_ID", "OP_ID", "TIRES_BUILT", "OPERATOR_NAME"} <= set(fact.columns) and fact.count() == 2
    bad = spark.createDataFrame([("1", ts(D1), 1)], "OP_ID string, DATE timestamp_ntz, PIECES int")
    with pytest.raises(ValueError, match="PIECES"):
        fact_second_step(bad, star.operators)


def test_events_need_a_code_and_a_date(star, rows):
    got = rows(star.fact_conf_bc, "OP_ID", "CQ_CODE_STR", "CQ_DESCRIPTION", "CQ_RELATES_TO", "BU")
    assert got == [
        ("000001", "12.5", "bulge", "Confection", "E"), ("000001", "12.5", "bulge", "Confection", "E"),
        ("000002", "", None, None, "W"), ("000002", "X50", "cut", " finishing ", "W"), ("000003", "7", "mark", "Finishing", None),
    ]


def test_uniformity_is_dated_by_build_or_else_by_test(star, rows):
    got = rows(star.fact_uniformity, "BARCODE", "OP_ID", "IS_RFT", "IS_REPAIRED", "PROD_DATE")
    may4, may12 = dt.date(2026, 5, 4), dt.date(2026, 5, 12)
    assert got == [(10, "000001", 0, 1, may4), (10, "000001", 1, 0, may4), (11, "000002", 1, 0, may12), (None, "000001", 1, 0, may4)]


def test_kpi_summary_loses_events_without_production(first_facts, rows):
    got = rows(agg.agg_kpi_summary(*first_facts), "BU", "PROD_WEEK", "TIRES_BUILT", "OPERATORS", "BC_COUNT", "AC_COUNT", "SCRAP_LBS", "BC_PCT")
    assert got == [
        ("E", 19, 100.0, 1, 2, 0, 3.25, 2.0), ("E", 20, 50.0, 1, 0, 1, 0.0, 0.0), ("W", 19, 200.0, 1, 2, 1, 1.0, 1.0),
        (None, 19, 12.0, 2, 0, 0, 4.0, 0.0),
    ]


def test_trend_has_overall_rows_apart_from_a_missing_unit(first_facts, rows):
    trend = agg.agg_weekly_trend(agg.agg_kpi_summary(*first_facts))
    got = rows(trend, "BU", "PROD_WEEK", "TIRES_BUILT", "BC_COUNT", "WEEK_LABEL")
    assert got == [
        ("ALL", 19, 312.0, 4, "2026-W19"), ("ALL", 20, 50.0, 0, "2026-W20"), ("E", 19, 100.0, 2, "2026-W19"),
        ("E", 20, 50.0, 0, "2026-W20"), ("W", 19, 200.0, 2, "2026-W19"), (None, 19, 12.0, 0, "2026-W19"),
    ]


def test_second_step_trend_keeps_weeks_with_production(star, rows):
    trend = agg.agg_weekly_trend_fin(star.fact_second_step, star.fact_conf_bc, star.fact_conf_ac)
    got = rows(trend, "BU", "PROD_WEEK", "TIRES_BUILT", "BC_COUNT", "AC_COUNT", "SCRAP_LBS")
    # the finishing event of an unknown unit in week 20 shows in the overall row only
    assert got == [("ALL", 19, 150.0, 1, 0, 0.0), ("ALL", 20, 10.0, 1, 1, 0.0), ("E", 20, 10.0, 0, 1, 0.0), ("W", 19, 150.0, 1, 0, 0.0)]


def test_donut_shares_run_over_all_weeks(star, rows):
    got = rows(agg.agg_donut(star.fact_conf_bc), "BU", "CQ_CODE_STR", "CQ_COUNT", "BU_CREW_TOTAL", "PCT_OF_SLICE")
    assert got == [("E", "12.5", 2, 2, 100.0), ("W", "", 1, 2, 50.0), ("W", "X50", 1, 2, 50.0), (None, "7", 1, None, None)]
    scrap = rows(agg.agg_donut_scrap(star.fact_nc_scrap), "BU", "TBM", "SCRAP_LBS", "EVENTS", "LBS_PER_TIRE", "PCT_OF_SLICE")
    assert scrap == [("E", "T1", 3.25, 1, 1.625, 100.0), ("W", "T1", 1.0, 1, None, 100.0), (None, "T2", 4.0, 0, 4.0, None)]


def test_leaderboard_counts_distinct_dates_and_drops_missing_ids_on_the_right(first_facts, rows):
    board = agg.agg_top_performers(*first_facts)
    got = rows(board, "OP_ID", "TIRES_BUILT", "SHIFTS_WORKED", "BC_COUNT", "SCRAP_LBS", "RANKABLE", "QUALITY_SCORE", "RANK")
    # norms: BC 1.333/1.333 and 1/1.333, AC .667 and .5 of .667, scrap .022 and .005 of .022
    assert got == [
        ("000001", 150.0, 2, 2, 3.25, True, 100.0, 2), ("000002", 200.0, 1, 2, 1.0, True, 57.57, 1), ("000009", 0.0, 1, 0, 0.0, False, 0.0, None),
        ("0000ab", 5.0, 1, 0, 0.0, False, 0.0, None), (None, 7.0, 1, 0, 0.0, False, 0.0, None),
    ]


def test_second_step_leaderboard_scopes_events_to_its_step(star, rows):
    facts = (star.fact_second_step, star.fact_conf_bc, star.fact_conf_ac, star.fact_nc_scrap, star.fact_uniformity)
    columns = ("OP_ID", "BC_COUNT", "AC_COUNT", "UNI_TESTED", "UNI_RFT", "RFT_PCT")
    assert rows(agg.agg_top_performers_fin(*facts), *columns) == [("000001", 0, 1, 1, 1, 100.0), ("000002", 1, 0, 1, 2, 200.0)]
    assert rows(agg.agg_top_performers_fin(*facts, ac_scope=None), *columns)[1][:3] == ("000002", 1, 1)


def test_first_test_decides_uniformity_by_week(spark, star, rows):
    tests = star.catalog.read("uniformity_breakdown")
    columns = ("BU", "PROD_WEEK", "TIRES_TESTED", "RFT_COUNT", "REPAIR_COUNT", "RFT_PCT")
    # tire 10 failed its first test; the test without a barcode counts no tire
    assert rows(agg.agg_uniformity(tests, star.operators), *columns) == [("E", 20, 1, 1, 0, 100.0), ("W", 19, 0, 1, 0, None), ("W", 20, 1, 0, 1, 0.0)]
    built = rows(agg.agg_uniformity(tests, star.operators, "Confection"), *columns)
    assert built == [("E", 19, 1, 1, 1, 100.0), ("W", None, 1, 1, 0, 100.0)]
    bare = tests.select("BARCODE", "CONFECTION_OPERATOR_ID", "CONFECTION_TIMESTAMP")
    assert rows(agg.agg_uniformity(bare, star.operators), "BU", "TIRES_TESTED", "RFT_COUNT") == [("E", 1, 0), ("W", 1, 0)]


@pytest.fixture(scope="module")
def op_week(star, first_facts):
    return agg.agg_op_week(*first_facts, star.fact_uniformity)


def test_operator_weeks_of_any_input_are_kept(op_week, rows):
    got = rows(op_week, "OP_ID", "PROD_WEEK", "TIRES_BUILT", "SHIFTS", "BC_COUNT", "AC_COUNT", "SCRAP_LBS", "UNI_TESTED", "UNI_RFT", "BU")
    assert got == [
        ("000001", 19, 100.0, 1, 2, 0, 3.25, 1, 2, "E"), ("000001", 20, 50.0, 1, 0, 0, 0.0, 0, 0, "E"),
        ("000002", 19, 200.0, 1, 0, 1, 1.0, 0, 0, "W"), ("000002", 20, 0.0, 0, 0, 0, 0.0, 1, 1, "W"),
        ("000009", 19, 0.0, 1, 0, 0, 0.0, 0, 0, None), ("0000ab", 19, 5.0, 1, 0, 0, 0.0, 0, 0, None), (None, 19, 7.0, 1, 0, 0, 4.0, 0, 0, None),
    ]


def test_measures_are_conserved(op_week, star):
    sums = op_week.agg(F.sum("TIRES_BUILT"), F.sum("SCRAP_LBS")).first()
    assert sums[0] == star.fact_first_step.agg(F.sum("TIRES_BUILT")).first()[0]
    assert sums[1] == star.fact_nc_scrap.agg(F.sum("OP_SCRAP_LBS_BY_TIRES")).first()[0]


def test_rollup_recomputes_scores_within_the_selection(op_week, rows):
    everything = card.op_rollup(op_week)
    got = rows(everything.where("OPERATOR_NAME IS NOT NULL"), "OP_ID", "TIRES_BUILT", "SHIFTS_WORKED", "RFT_PCT", "RANK")
    assert got == [("000001", 150.0, 2, 200.0, 1), ("000002", 200.0, 1, 100.0, 2)]
    week = card.op_rollup(op_week, Filters(weeks=[20]))
    assert rows(week, "OP_ID", "TIRES_BUILT", "RANKABLE", "RANK") == [("000001", 50.0, False, None), ("000002", 0.0, False, None)]


def test_rollup_falls_back_to_the_period_leaderboard(spark, op_week, first_facts, rows):
    period = agg.agg_top_performers(*first_facts)
    expected = [("000001", 2)]
    chosen = Filters(bus=["E"], weeks=[1])
    assert rows(card.op_rollup(None, chosen, period=period), "OP_ID", "RANK") == expected
    assert rows(card.op_rollup(op_week.limit(0), chosen, period=period), "OP_ID", "RANK") == expected
    with pytest.raises(ValueError):
        card.op_rollup(None)


def test_top_lists(op_week, rows):
    rollup = card.op_rollup(op_week)
    assert [r.OP_ID for r in card.quality_top(rollup, 1).collect()] == ["000001"]
    assert [r.OP_ID for r in card.scrap_top(rollup, 5).collect()] == ["000001", "000002"]
    panels = {(r.PANEL, r.POSITION): r.OP_ID for r in card.rankings(rollup, 5).collect()}
    assert panels == {
        ("SCORE", 1): "000001", ("SCORE", 2): "000002", ("RFT", 1): "000001", ("RFT", 2): "000002",
        ("AC", 1): "000002", ("AC", 2): "000001", ("BC", 1): "000001", ("BC", 2): "000002",
    }


LEAKS = "MATRICULE bigint, OP_ID bigint, OPERATOR_NAME string, BU string, CREW int, COUNTER_VERIFIER_ID int, SHIFT string, IS_LEAK int, YEAR int, WEEK int"


@pytest.fixture(scope="module")
def leak_tests(spark):
    data = [(i, 1, "Ann", "E", 1, 3, "A", int(i < 6), 2026, 19) for i in range(60)]
    data += [(100 + i, 2, "Bob", "W", 2, None if i else 4, "B", 1, 2026, 20) for i in range(20)]
    data += [(None, 7, None, None, None, 3, None, int(i < 20), 2026, 20) for i in range(40)]
    return spark.createDataFrame(data, LEAKS)


def test_kpi_row(op_week, leak_tests):
    row = card.kpi_summary(op_week, leak_tests, Filters(bus=["E"])).first()
    assert (row.TIRES_BUILT, row.BC_COUNT, row.VERIFIED, row.LEAKS) == (150.0, 2, 60, 6)
    assert (row.BC_BAND, row.AC_BAND, row.RFT_BAND, row.LEAK_BAND, row.LEAK_ALERT) == ("warn", "good", "good", "bad", True)
    empty = card.kpi_summary(op_week, leak_tests, Filters(bus=["nowhere"])).first()
    assert (empty.TIRES_BUILT, empty.BC_PCT, empty.RFT_PCT, empty.LEAK_PCT) == (0.0, 0.0, 0.0, 0.0)


def test_leak_reports(leak_tests, rows):
    assert tuple(card.leak_kpis(leak_tests).select("TESTED", "LEAKS", "OK").first()) == (120, 46, 74)
    assert rows(card.leaks_by(leak_tests, "COUNTER_VERIFIER_ID")) == [(3, 26), (4, 1)]
    assert rows(card.leaks_by(leak_tests, "SHIFT", n=None)) == [("A", 6), ("B", 20)]
    assert rows(card.leak_trend(leak_tests), "WEEK", "TESTED", "LEAKS", "LEAK_PCT") == [(19, 60, 6, 10.0), (20, 60, 40, 66.667)]
    # fewer than 30 tests: Bob is left out; a missing name is shown by id
    assert rows(card.leak_worst(leak_tests), "LABEL", "LEAK_PCT") == [("000007", 50.0), ("Ann", 10.0)]
    assert rows(factboard.leak_worst_known(leak_tests), "OP_ID", "TESTED", "LEAK_PCT") == [("000001", 60, 10.0)]
    assert rows(factboard.leak_trend_by_id(leak_tests), "WEEK", "CV_TIRES", "CV_LEAKS") == [(19, 60, 6), (20, 20, 40)]


def test_breakdowns(spark, star, rows):
    donut = agg.agg_donut(star.fact_conf_bc)
    # step 1 keeps its own events; only one tier, so the first column with any is taken
    assert rows(card.breakdown(donut, "1", "bc")) == [("Tier 1", False, 2)]
    # the finishing event without a unit is left out
    assert rows(card.breakdown(donut, "2", "bc")) == [("Tier 2", False, 1)]
    assert rows(card.breakdown(donut, "2", "ac")) == [("Tier 1", False, 2), ("Tier 2", False, 1)]
    untagged = donut.withColumn("CQ_RELATES_TO", F.lit(None).cast("string"))
    assert rows(card.breakdown(untagged, "1", "bc")) == [("Tier 1", False, 2), ("Tier 2", False, 1)]
    flat = donut.withColumn("CQ_TYPE_TIER", F.lit("only"))
    assert rows(card.breakdown(flat, "2", "ac")) == [("bulge", False, 2), ("cut", False, 1)]


def test_trend_sources(star, op_week, first_facts, rows):
    live = rows(card.weekly_trend(op_week, Filters(bus=["E"])), "PROD_WEEK", "TIRES", "BC_PCT", "RFT_PCT", "WK")
    assert live == [(19, 100.0, 2.0, 200.0, "W19"), (20, 50.0, 0.0, None, "W20")]
    trend = agg.agg_weekly_trend(agg.agg_kpi_summary(*first_facts))
    tests = agg.agg_uniformity(star.catalog.read("uniformity_breakdown"), star.operators)
    period = rows(card.weekly_trend_from_periods(trend, tests), "PROD_WEEK", "TIRES", "BC", "RFT_PCT")
    assert period == [(19, 312.0, 4, None), (20, 50.0, 0, 50.0)]
    assert rows(card.weekly_trend_from_periods(trend, None, Filters(bus=["W"])), "PROD_WEEK", "RFT_PCT") == [(19, None)]


def test_options_and_names(spark, op_week, leak_tests, rows):
    got = rows(card.filter_options([], [op_week], [], leak_tests))
    assert got == [("BU", "E"), ("BU", "W"), ("CREW", "1"), ("CREW", "2"), ("WEEK", "19"), ("WEEK", "20")]
    later = spark.createDataFrame([("1", "Ann B."), ("5", None)], "OP_ID string, OPERATOR_NAME string")
    assert rows(card.name_lookup(op_week, later)) == [("000001", "Ann B."), ("000002", "Bob")]


def test_fact_reports(first_facts, star, rows):
    kpis = factboard.fact_kpis(*first_facts).first()
    assert (kpis.TIRES_BUILT, kpis.BC_COUNT, kpis.AC_COUNT, kpis.SCRAP_LBS) == (362.0, 5, 2, 8.25)
    assert rows(factboard.event_donut(star.fact_conf_bc)) == [("", 1), ("bulge", 2), ("cut", 1), ("mark", 1)]
    assert rows(factboard.scrap_donut(star.fact_nc_scrap)) == [("T1", 4.25), ("T2", 4.0)]
    assert rows(factboard.fact_trend(*first_facts), "PROD_WEEK", "BC_COUNT", "AC_COUNT") == [(19, 4, 1), (20, 1, 1)]


def test_refresh_builds_every_table(spark, tmp_path, op_week, rows):
    out = Catalog(spark, str(tmp_path))
    built = refresh(Catalog(spark, tables=tables(spark)), out, period_tables=True)
    assert "agg_op_week_fin" in built and "agg_top_performers_fin" in built and len(built) == 19
    assert rows(out.read("agg_op_week"), *op_week.columns) == rows(op_week)
    # written by week, so a week filter reads its folders only
    plan = out.read("fact_first_step").where("PROD_WEEK = 19")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(PROD_WEEK" in plan
    again = refresh(Catalog(spark, tables=tables(spark)), out, partition_facts=False)
    assert len(again) == 12


def test_refresh_goes_on_after_a_failure_and_reports_it(spark, tmp_path):
    sources = tables(spark)
    del sources["nc_scrap"]
    with pytest.raises(RefreshFailed) as problem:
        refresh(Catalog(spark, tables=sources), Catalog(spark, str(tmp_path)))
    assert set(problem.value.failures) == {"fact_nc_scrap", "agg_donut_scrap", "agg_op_week", "agg_op_week_fin"}
    assert Catalog(spark, str(tmp_path)).read("agg_donut_bc").count() == 4


def test_a_reader_meets_one_run_throughout(spark, tmp_path, rows, monkeypatch):
    root, sources = str(tmp_path), tables(spark)
    refresh(Catalog(spark, tables=sources), Catalog(spark, root))
    early = Catalog(spark, root)
    before = {n: rows(early.read(n)) for n in ("agg_donut_bc", "fact_first_step", "agg_op_week")}
    during = []

    def watched(build):
        def built(*facts):
            # another reader, in the middle of the second run
            during.append({n: rows(Catalog(spark, root).read(n)) for n in before})
            return build(*facts)
        return built

    monkeypatch.setattr(agg, "agg_op_week", watched(agg.agg_op_week))
    sources["first_step_prod"] = sources["first_step_prod"].withColumn("TIRES_BUILT", F.col("TIRES_BUILT") * 2)
    late = Catalog(spark, root)
    assert late.snapshot.number == 1
    refresh(Catalog(spark, tables=sources), Catalog(spark, root))
    assert during == [before]
    # one that looked before stays with what it saw, also for tables it opens only now
    assert {n: rows(late.read(n)) for n in before} == before
    assert {n: rows(early.read(n)) for n in before} == before
    late.renew()
    assert late.snapshot.number == 2 and len(set(late.snapshot.runs.values())) == 1
    assert rows(late.read("agg_op_week")) != before["agg_op_week"]


def test_the_second_of_two_runs_is_not_published(spark, tmp_path, rows, monkeypatch):
    root, sources = str(tmp_path), tables(spark)
    build = agg.agg_op_week

    def overtaken(*facts):
        monkeypatch.setattr(agg, "agg_op_week", build)
        refresh(Catalog(spark, tables=sources), Catalog(spark, root))
        return build(*facts)

    monkeypatch.setattr(agg, "agg_op_week", overtaken)
    with pytest.raises(SnapshotConflict):
        refresh(Catalog(spark, tables=sources), Catalog(spark, root))
    assert Catalog(spark, root).snapshot.number == 1


def test_first_tests_from_buckets_need_no_shuffle(spark, tmp_path, star, rows):
    source = agg.test_columns(star.catalog.read("uniformity_breakdown"))
    stored = write_bucketed(source, str(tmp_path / "tests"), "BARCODE", buckets=4)
    for step in ("Confection", "Finishing"):
        got = agg.agg_uniformity(stored, star.operators, step, by_barcode=True)
        assert rows(got) == rows(agg.agg_uniformity(source, star.operators, step))
    again = read_bucketed(spark, str(tmp_path / "tests"), "BARCODE", buckets=4)
    first = first_of_bucketed(again.where("BARCODE is not null"), ["BARCODE"], ["TEST_DATETIME"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(BARCODE" not in plan and "SortAggregate" not in plan and "Bucketed: true" in plan
    whole = agg.agg_uniformity(again, star.operators, "Confection", by_barcode=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(BARCODE" not in whole


def test_a_later_refresh_builds_nothing_from_old_facts(spark, tmp_path, rows):
    sources, out = tables(spark), Catalog(spark, str(tmp_path))
    refresh(Catalog(spark, tables=sources), out)
    old = rows(out.read("agg_donut_scrap"))
    del sources["nc_scrap"]
    with pytest.raises(RefreshFailed) as problem:
        refresh(Catalog(spark, tables=sources), out)
    assert set(problem.value.failures) == {"fact_nc_scrap", "agg_donut_scrap", "agg_op_week", "agg_op_week_fin"}
    # the old table is still there, whole
    assert rows(Catalog(spark, str(tmp_path)).read("agg_donut_scrap")) == old


def test_a_damaged_file_stops_its_own_step_only(spark, tmp_path):
    sources, damaged = tables(spark), tmp_path / "damaged"
    sources["nc_scrap"].write.parquet(str(damaged))
    for file in damaged.glob("part-*"):
        file.write_bytes(file.read_bytes()[:-200] + b"x" * 200)
    sources["nc_scrap"] = spark.read.schema(sources["nc_scrap"].schema).parquet(str(damaged))
    with pytest.raises(RefreshFailed) as problem:
        refresh(Catalog(spark, tables=sources), Catalog(spark, str(tmp_path / "out")))
    assert set(problem.value.failures) == {"fact_nc_scrap", "agg_donut_scrap", "agg_op_week", "agg_op_week_fin"}
    assert Catalog(spark, str(tmp_path / "out")).read("agg_donut_bc").count() == 4


def test_operator_lookup_has_one_row_per_id(star):
    lookup = operator_lookup(star.dim_operator)
    names = {r.OP_ID: (r.OPERATOR_NAME, r.BU) for r in lookup.table.collect()}
    assert names["000001"] == ("Ann", "E") and names["000002"] == ("Bob", "W") and names["0000AB"] == ("Cy", None)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_filters_reach_the_files_of_a_fact_built_on_the_fly(spark, tmp_path, rows):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name, df in tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    star = Star(Catalog(spark, str(tmp_path)), min_date=None)
    chosen = Filters(weeks=(19, 20), years=(2026,)).apply(star.fact_first_step).where("TBM = 'T1'")
    assert rows(chosen) == rows(star.fact_first_step.where("TBM = 'T1' and PROD_YEAR = 2026 and PROD_WEEK in (19, 20)"))
    pushed = next(s for s in scans(chosen) if "first_step_prod" in s).split("PushedFilters")[1]
    assert "EqualTo(TBM,T1)" in pushed and "GreaterThanOrEqual(PROD_DATE,2026-05-04" in pushed and "LessThan(PROD_DATE,2026-05-18" in pushed
    weeks = Filters(weeks=(19,)).apply(star.fact_nc_scrap)
    scan = next(s for s in scans(weeks) if "nc_scrap" in s)
    assert "weekofyear(" in scan.split("DataFilters")[1].split("Format")[0] and "IsNotNull(PROD_DATE)" in scan


def test_a_unit_filter_turns_the_lookup_into_an_inner_join(spark, star):
    plan = Filters(bus=("W",)).apply(star.fact_first_step)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LeftOuter, (" not in plan.split("Join Inner")[0]


@pytest.mark.parametrize("finishing", [False, True])
def test_names_and_options_need_no_figures(spark, rows, finishing):
    facts = [
        spark.createDataFrame([(i, None if i == "3" else f"N{i}", "E", 1, "S", y, w, 5.0, dt.date(2024, 1, 1)) for i, y, w in [("1", 2024, 1), ("1", 2024, 2), ("2.0", 2023, 7), ("3", None, None), (None, 2024, 9)]], "OP_ID string, OPERATOR_NAME string, BU string, CREW int, SUPERVISOR_CHORUS_ID string, PROD_YEAR int, PROD_WEEK int, TIRES_BUILT double, PROD_DATE date"),
        spark.createDataFrame([("4", 2024, 11, "Confection", "a"), ("5", 2024, 12, "Finishing", "a"), ("6", 2024, 13, "Confection", None)], "OP_ID string, PROD_YEAR int, PROD_WEEK int, CQ_RELATES_TO string, CQ_CODE_STR string"),
        spark.createDataFrame([("7", 2024, 21, None, "a"), ("2", 2024, 22, "Confection", "b")], "OP_ID string, PROD_YEAR int, PROD_WEEK int, CQ_RELATES_TO string, CQ_CODE_STR string"),
        spark.createDataFrame([("8", 2024, 31, 1.0)], "OP_ID string, PROD_YEAR int, PROD_WEEK int, OP_SCRAP_LBS_BY_TIRES double"),
        spark.createDataFrame([("9", "1", 2024, 41, 1, 1), (None, "x", 2024, None, 2, 0)], "OP_ID string, FINISHING_OPERATOR_ID string, PROD_YEAR int, PROD_WEEK int, BARCODE int, IS_RFT int"),
    ]
    whole = (agg.agg_op_week_fin if finishing else agg.agg_op_week)(*facts)
    names = agg.operator_week_values(*facts, "OP_ID", finishing)
    assert rows(names, "OP_ID", "OPERATOR_NAME", "BU", "CREW") == rows(whole.select("OP_ID", "OPERATOR_NAME", "BU", "CREW").distinct())
    assert rows(agg.operator_week_values(*facts, "PROD_WEEK", finishing)) == rows(whole.select("PROD_WEEK").distinct())
    board = agg.agg_top_performers_fin(*facts) if finishing else agg.agg_top_performers(*facts[:4])
    people = agg.leaderboard_operators(facts[0], finishing)
    assert rows(people) == rows(board.select(*people.columns))


def test_the_weeks_of_an_operator_come_to_one_of_many_tasks(spark, rows, tmp_path, monkeypatch):
    from opquality.operators import measures

    path = str(tmp_path / "facts")
    spark.range(3000).selectExpr(
        "CASE WHEN id % 50 > 0 THEN lpad(cast(id % 90 AS string), 6, '0') END AS OP_ID", "CASE WHEN id % 3 > 0 THEN concat('name ', id % 90) END AS OPERATOR_NAME",
        "'E' AS BU", "id % 4 AS CREW", "timestampadd(DAY, id % 500, timestamp_ntz'2020-01-01') AS PROD_DATE", "2020 + id % 500 DIV 366 AS PROD_YEAR", "id % 53 AS PROD_WEEK",
        "id / 8 AS TIRES_BUILT", "cast(id % 9 AS string) AS CQ_CODE_STR", "'Confection' AS CQ_RELATES_TO", "id * 1.5 AS OP_SCRAP_LBS_BY_TIRES", "id AS BARCODE", "id % 2 AS IS_RFT",
    ).repartition(2).write.parquet(path)
    facts = [spark.read.parquet(path)] * 5
    whole = rows(agg.agg_op_week(*facts))
    size = sum(f.stat().st_size for f in (tmp_path / "facts").glob("*.parquet"))
    monkeypatch.setattr(measures, "BYTES_A_PLACE", size // 12)
    weeks = agg.agg_op_week(*facts)
    assert rows(weeks) == whole
    # More input, more tasks, and none of them reads more than its operators.
    places = weeks.select("OP_ID", F.spark_partition_id().alias("place")).distinct().collect()
    assert len({r.OP_ID for r in places}) == len(places) and len({r.place for r in places}) > 8
