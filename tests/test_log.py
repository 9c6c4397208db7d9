"""Inspection log: cleaning, numbering, grid queries, change sets; sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opquality.plans import log
from opquality.sources.columns import first_column, project, resolve_column
from opquality.sources.profile import fact_diagnostics, head, profile, profile_tables, value_counts
from opquality.sources.readers import Catalog, read_text_table
from opquality.sources.writers import json_records, overwrite_table, write_json

SCHEMA = ", ".join(f"`{c}` string" for c in log.LOG_COLUMNS)


def log_row(**values):
    names = {"rack": "RACK ID", "qty": "Quantity", "out": "Date Removed", "max": "Max. Date For Recoup <30 days", "place": "Location (cage / overflow)"}
    filled = {names[k]: v for k, v in values.items()}
    return tuple(filled.get(c) for c in log.LOG_COLUMNS)


@pytest.fixture(scope="module")
def raw(spark):
    data = [
        log_row(rack=" R2 ", qty="3", out="26-May"), log_row(rack=" ", qty="", out="\t"), log_row(qty=" 5 "),
        log_row(rack="R10", out="   ", place="cage"), log_row(), log_row(rack="r1", max="12-Nov", place="Cage B"),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_only_rows_blank_throughout_are_dropped(raw):
    got = {(r["RACK ID"], r["Quantity"], r["Date Removed"], r["Status"]) for r in log.clean_log(raw).collect()}
    # year-less dates stay text
    assert got == {("R2", "3", "26-May", "Closed"), (None, "5", None, "Open"), ("R10", None, None, "Open"), ("r1", None, None, "Open")}
    assert tuple(log.clean_report(raw).first()) == (6, 2, 4, 1, 3)


def test_row_ids_replace_existing_ones(raw):
    numbered = log.add_row_id(log.add_row_id(raw, ["RACK ID"]), ["RACK ID", "Quantity"])
    assert numbered.columns[0] == "row_id" and numbered.columns.count("row_id") == 1
    assert sorted(r.row_id for r in numbered.collect()) == [1, 2, 3, 4, 5, 6]


@pytest.fixture(scope="module")
def saved(spark):
    data = [(1, "R2", "Open"), (2, "r10", "Closed"), (3, "12b", "Open"), (4, None, "Open"), (5, "3", "Open"), (7, "R1", "Closed"), (8, "", "Open")]
    return spark.createDataFrame(data, "row_id bigint, `RACK ID` string, Status string")


def ids(df):
    return [r.row_id for r in df.orderBy("POSITION").collect()]


def test_natural_sort_keeps_blanks_last_both_ways(saved):
    assert ids(log.grid_query(saved, sort="RACK ID")) == [5, 3, 7, 1, 2, 4, 8]
    assert ids(log.grid_query(saved, sort="RACK ID", descending=True)) == [2, 1, 7, 3, 5, 4, 8]
    assert ids(log.grid_query(saved, limit=2)) == [1, 2]


def test_exact_columns_compare_whole_and_others_contain(saved):
    assert ids(log.grid_query(saved, {"Status": "Closed"}, search="R1")) == [2, 7]
    assert ids(log.grid_query(saved, {"Status": "close"})) == []
    assert ids(log.grid_query(saved, {"RACK ID": "R1"})) == [2, 7]
    assert ids(log.grid_query(saved, {"RACK ID": "R1"}, exact=["RACK ID"])) == [7]
    assert tuple(log.grid_counts(saved, {"RACK ID": "r"}, limit=2).first()) == (3, 7, 2)
    assert tuple(log.grid_counts(saved, {"RACK ID": "r"}).first()) == (3, 7, 3)


def test_all_rows_are_numbered_without_a_limit(spark):
    many = spark.range(1, 4001).selectExpr("id AS row_id", "concat('x', cast(id * 7919 % 4001 as string)) AS `RACK ID`", "'Open' AS Status").repartition(5)
    got = [(r.POSITION, r["RACK ID"]) for r in log.grid_query(many, sort="RACK ID").orderBy("POSITION").collect()]
    assert got == [(n, f"x{n}") for n in range(1, 4001)]


def test_a_page_in_the_middle(spark, saved):
    many = spark.range(1, 2001).selectExpr("id AS row_id", "CASE WHEN id % 9 = 0 THEN '' ELSE concat('x', cast(id * 7919 % 2003 as string)) END AS `RACK ID`", "'Open' AS Status").repartition(5)
    for descending in (False, True):
        whole = [tuple(r) for r in log.grid_query(many, sort="RACK ID", descending=descending).orderBy("POSITION").collect()]
        page = [tuple(r) for r in log.grid_query(many, sort="RACK ID", descending=descending, limit=25, offset=1000).orderBy("POSITION").collect()]
        assert page == whole[1000:1025]
    assert ids(log.grid_query(saved, sort="RACK ID", limit=3, offset=2)) == [7, 1, 2]
    assert ids(log.grid_query(saved, sort="RACK ID", offset=5)) == [4, 8]


def test_suggestions_by_frequency_up_to_a_limit(spark, rows):
    df = spark.createDataFrame([("a", str(i)) for i in range(6)] + [(" b ", "x"), ("b", None), ("b", " ")], "c string, many string")
    got = log.suggestions(df, 4)
    assert [(r.COLUMN, r.VALUE, r.FREQUENCY) for r in got.collect()] == [("c", "a", 6), ("c", "b", 3)]
    assert {r.COLUMN for r in log.suggestions(df).collect()} == {"c", "many"}
    assert log.suggestions(df.where("false")).count() == 0
    assert log.distinct_counts(df.withColumn("Status", F.lit("Open")), ["many", "Status", "gone"]) == {"many": 7, "Status": 1}


BASE = "row_id bigint, `RACK ID` string, `Date Removed` string, Status string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "A", None, "Open"), (5, "B", "1-May", "Closed")], BASE)


def changes(spark, inserts=(), updates=()):
    new = spark.createDataFrame(list(inserts), "seq bigint, `RACK ID` string, `Date Removed` string") if inserts else None
    edits = spark.createDataFrame(list(updates), "seq bigint, row_id string, `RACK ID` string, `Date Removed` string") if updates else None
    return new, edits


def test_change_set(spark, base, rows):
    inserts, updates = changes(
        spark,
        [(2, "second", " "), (1, "first", "3-May"), (3, "  ", None)],
        [(1, "1", "lost", None), (2, "1.0", " won ", "9-May"), (3, "99", "unknown", None), (4, "x", "no number", None), (5, "7", "hits an insert", "")],
    )
    got = rows(log.apply_changes(base, inserts, updates))
    # ids continue after the largest; text is stored as given, blanks as NULL
    assert got == [
        (1, " won ", "9-May", "Closed"), (5, "B", "1-May", "Closed"), (6, "first", "3-May", "Closed"),
        (7, "hits an insert", None, "Open"), (8, None, None, "Open"),
    ]
    assert log.change_counts(inserts, updates) == {"inserted": 3, "updated": 5}


def test_updates_replace_every_column_and_repeat_without_effect(spark, base, rows):
    _, updates = changes(spark, updates=[(1, "5", "C", None)])
    narrow = updates.drop("Date Removed")
    once = log.apply_changes(base, None, narrow)
    assert rows(once) == [(1, "A", None, "Open"), (5, "C", None, "Open")]
    assert rows(log.apply_changes(once, None, narrow)) == rows(once)


def test_empty_log_starts_at_one_and_empty_change_set_fails(spark, base, rows):
    inserts, _ = changes(spark, [(1, "n", None)])
    assert rows(log.apply_changes(base.limit(0), inserts)) == [(1, "n", None, "Open")]
    with pytest.raises(ValueError):
        log.apply_changes(base, inserts.limit(0), None)


def test_saving_switches_versions_only_when_complete(spark, base, rows, tmp_path):
    path = str(tmp_path / "log")
    assert log.current_version(spark, path) == 0
    inserts, updates = changes(spark, [(1, "n", None)], [(1, "6", "edited", None)])
    assert log.save_changes(spark, path, base, inserts) == {"inserted": 1, "updated": 0}
    assert log.save_changes(spark, path, base, None, updates) == {"inserted": 0, "updated": 1}
    # a version without its commit row, as a failed job leaves it, is not read
    base.write.parquet(f"{path}/base-left")
    assert log.current_version(spark, path) == 2
    assert rows(log.load_log(spark, path, base)) == [(1, "A", None, "Open"), (5, "B", "1-May", "Closed"), (6, "edited", None, "Open")]


def files(path, kind):
    return {str(f) for f in path.glob(f"{kind}-*/*.parquet")}


def test_a_save_writes_no_base_file(spark, base, rows, tmp_path):
    path = tmp_path / "log"
    inserts, updates = changes(spark, [(1, "n", None)], [(1, "1", "one", None)])
    log.save_changes(spark, str(path), base, inserts)
    first, added = files(path, "base"), files(path, "added")
    log.save_changes(spark, str(path), base, None, updates)
    assert files(path, "base") == first and files(path, "added") == added
    assert sum(spark.read.parquet(f).count() for f in files(path, "updates")) == 1
    assert rows(log.load_log(spark, str(path), base)) == [(1, "one", None, "Open"), (5, "B", "1-May", "Closed"), (6, "n", None, "Open")]


def test_folded_change_sets_equal_applied_ones(spark, base, rows, tmp_path):
    path = str(tmp_path / "log")
    sets = [
        changes(spark, [(2, "b", None), (1, "a", "2-May")], [(1, "7", "hits an insert", None), (2, "9", "comes later", None)]),
        changes(spark, [(1, "c", None)], [(1, "1", "x", None), (2, "6", "y", " "), (3, "1", "z", "3-May"), (4, "3", "never was", None)]),
        changes(spark, [(1, "d", None)], [(1, "9", "now it is", None), (2, "7", "last", None)]),
    ]
    plain = base
    for n, (inserts, updates) in enumerate(sets):
        plain = log.apply_changes(plain, inserts, updates)
        log.save_changes(spark, path, base, inserts, updates)
        assert rows(log.load_log(spark, path, base)) == rows(plain)
        if n == 1:
            before = rows(log.load_log(spark, path, base))
            assert log.compact(spark, path) == 3 == log.current_version(spark, path)
            assert rows(log.load_log(spark, path, base)) == before
    assert log.current_version(spark, path) == 4


def test_a_lookup_by_id_skips_files_of_the_base(spark, tmp_path):
    path = str(tmp_path / "log")
    many = spark.range(1, 20_001).selectExpr("id AS row_id", "concat('r', id) AS `RACK ID`", "cast(null as string) AS `Date Removed`", "'Open' AS Status")
    inserts, updates = changes(spark, [(1, "n", None)], [(1, "15000", "new", None)])
    log.save_changes(spark, path, many, inserts, updates)
    some = log.load_rows(spark, path, many, 14_999, 15_001)
    assert [r["RACK ID"] for r in some.orderBy("row_id").collect()] == ["r14999", "new", "r15001"]
    assert "GreaterThanOrEqual(row_id,14999)" in some._jdf.queryExecution().executedPlan().toString()


def test_the_second_of_two_writers_fails(spark, base, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    inserts, updates = changes(spark, [(1, "n", None)], [(1, "5", "edited", None)])
    counted = log.change_counts

    def overtaken(*args):
        monkeypatch.setattr(log, "change_counts", counted)
        log.save_changes(spark, path, base, inserts)
        return counted(*args)

    monkeypatch.setattr(log, "change_counts", overtaken)
    with pytest.raises(log.SaveConflict):
        log.save_changes(spark, path, base, None, updates)
    assert log.current_version(spark, path) == 1
    assert [r["RACK ID"] for r in log.load_log(spark, path, base).orderBy("row_id").collect()][-1] == "n"


def test_an_emptied_commit_folder_is_no_new_log(spark, base, tmp_path):
    path = tmp_path / "log"
    (path / "commits").mkdir(parents=True)
    with pytest.raises(ValueError):
        log.load_log(spark, str(path), base)


def test_column_resolution():
    names = ["FIN_OP_ID", "Cq_Main_Code", "MY_PROD_DATE", "OP_ID"]
    assert resolve_column(names, exact=["OP_ID"], suffix="OP_ID") == "OP_ID"
    assert resolve_column(names, suffix="OP_ID") == "FIN_OP_ID"
    assert resolve_column(names, exact=["CQ_CODE"], contains=["CQ", "CODE"]) == "Cq_Main_Code"
    assert resolve_column(names, exact=["x"], default="d") == "d" and resolve_column(names, exact=["x"]) is None
    assert first_column(names, exact="DATE", contains="PROD_DATE") == "MY_PROD_DATE"


def test_sources(spark, tmp_path, rows):
    root = str(tmp_path)
    overwrite_table(spark.createDataFrame([(1, "a")], "Id int, Name string"), f"{root}/t")
    spark.createDataFrame([], "Id int").write.parquet(f"{root}/empty")
    catalog = Catalog(spark, root)
    assert catalog.read("t", ["ID", "gone"]).columns == ["ID"]
    assert catalog.read_first_available("missing", "t").count() == 1
    assert catalog.read_first_nonempty("missing", "empty", "t")[1] == "t"
    assert catalog.read_or_empty("missing", "Id int").count() == 0
    assert project(catalog.read("t"), ["NAME"]).columns == ["NAME"]
    spark.createDataFrame([("007", "x")], "code string, v string").write.option("header", True).csv(f"{root}/csv")
    assert rows(read_text_table(spark, f"{root}/csv")) == [("007", "x")]


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2026, 5, 4, 6, 7, 8), float("nan"), None)], "i int, t timestamp_ntz, x double, s string")
    record = json.loads(json_records(df).first().RECORD)
    assert record == {"i": 1, "t": "2026-05-04 06:07:08", "x": None, "s": None}
    write_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_profile_quartiles_are_exact(spark):
    values = [3.0, 1.0, 2.0, 10.0, None, 2.0]
    df = spark.createDataFrame([(v, "t" if v else None) for v in values], "x double, s string").repartition(3)
    got = {r.COLUMN: r for r in profile(df).collect()}
    x = got["x"]
    assert (x.ROWS, x.VALUES, x.MEAN, x.MIN, x.MAX) == (6, 5, 3.6, 1.0, 10.0)
    assert (x.Q25, x.Q50, x.Q75) == (2.0, 2.0, 3.0)
    assert (got["s"].VALUES, got["s"].SAMPLE, got["s"].Q50) == (5, "t", None)
    assert head(df).count() == 5
    catalog = Catalog(spark, tables={"good": df})
    profiles, problems = profile_tables(catalog, ["good", "bad"])
    assert list(profiles) == ["good"] and list(problems) == ["bad"]


def test_diagnostics(spark, rows):
    df = spark.createDataFrame([("n", 1, 10), (None, 0, 10), (None, 0, 11)], "OPERATOR_NAME string, IS_RFT int, BARCODE int")
    row = fact_diagnostics(df).first()
    assert (row.ROWS, row.WITH_OPERATOR, row.IS_RFT_COUNT, row.TIRES) == (3, 1, 1, 2)
    assert rows(value_counts(df, "OPERATOR_NAME")) == [("n", 1), (None, 2)]
