"""Forms of ids, codes, dates and numbers, with hand-checked expectations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.dates import calendar_parts, short_week_label, to_datetime, week_label
from opquality.functions.ids import canonical_codes, normalized_ids
from opquality.functions.numbers import band, half_even, ratio, ratio_or_zero, total
from opquality.functions.text import WHITESPACE, blank_to_null, leading_number, natural_key, status_of

IDS = {
    # raw: (numeric, text)
    "5.0": ("000005", "000005"), " 12 ": ("000012", "000012"), "-5": ("-00005", "-00005"),
    "+5": ("000005", "+00005"), "12.7": ("000012", "0012.7"), "1e3": ("001000", "0001e3"),
    "0012345678": ("12345678", "0012345678"), "ab": ("0000ab", "0000ab"), "": ("000000", "000000"),
    "12d": ("00012d", "00012d"), "nan": ("000nan", "000nan"), "0-5": ("0000-5", "0000-5"),
    "x.0.0": ("0x.0.0", "000x.0"), "\xa09 ": ("000009", "000009"), "-12345678": ("-12345678", "-12345678"),
    None: (None, None),
}
CODES = {
    "75.10": "75.1", "777.0": "777", "1e3": "1000", "12345678": "12345678", "12.50": "12.5", " X50 ": "X50",
    "": "", "007": "7", ".5": "0.5", "0": "0", "12d": "12d", "12345678.5": "12345678.5", "-3.50": "-3.5", None: None,
}


def single(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_ids_in_both_modes(spark):
    df = normalized_ids(normalized_ids(single(spark, IDS), "x", "numeric", "n"), "x", "text", "t")
    got = {r.x: (r.n, r.t) for r in df.collect()}
    assert got == IDS


def test_ids_of_number_columns(spark):
    doubles = normalized_ids(single(spark, [5.0, 12.7, float("nan"), None, -3.0], "double"), "x", target="id")
    assert [r.id for r in doubles.orderBy("i").collect()] == ["000005", "000012", None, None, "-00003"]
    texts = normalized_ids(single(spark, [5.0, 12.7], "double"), "x", "text", "id")
    assert [r.id for r in texts.orderBy("i").collect()] == ["000005", "0012.7"]
    longs = normalized_ids(single(spark, [7, 12345678, None], "bigint"), "x", "text", "id")
    assert [r.id for r in longs.orderBy("i").collect()] == ["000007", "12345678", None]


def test_ids_replace_their_column_in_place(spark):
    df = spark.createDataFrame([("a", "7", 1)], "k string, OP_ID string, n int")
    assert normalized_ids(df).columns == ["k", "OP_ID", "n"]


def test_filters_on_ids_do_not_repeat_the_expression(spark):
    df = normalized_ids(normalized_ids(single(spark, ["7"]), "x", target="x"), "x", "text", "x")
    plan = df.where(F.col("x") == "000007")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lpad") <= 4


def test_codes(spark):
    got = {r.x: r.c for r in canonical_codes(single(spark, CODES), "x", "c").collect()}
    assert got == CODES
    doubles = canonical_codes(single(spark, [12.0, 75.1, 1e7, float("nan")], "double"), "x", "c")
    assert [r.c for r in doubles.orderBy("i").collect()] == ["12", "75.1", "10000000", None]


def test_whitespace_is_what_strip_removes():
    assert all(c.isspace() for c in WHITESPACE)
    assert {c for c in map(chr, range(0x3001)) if c.isspace()} == set(WHITESPACE)


def test_blanks_and_status(spark):
    df = single(spark, [" a ", "\t", "", None])
    got = [tuple(r) for r in df.orderBy("i").select(blank_to_null(F.col("x")), status_of(F.col("x"))).collect()]
    assert got == [("a", "Closed"), (None, "Open"), (None, "Open"), (None, "Open")]


def test_lenient_dates_and_parts(spark):
    df = single(spark, ["2027-01-01 07:30:00", "garbage", "05/04/2026", None])
    stamp = to_datetime(F.col("x"), T.StringType(), ["MM/dd/yyyy"])
    got = df.orderBy("i").select(stamp.alias("d")).withColumns(calendar_parts(F.col("d"), True)).collect()
    # ISO week with calendar year: the first of January 2027 is in week 53
    assert tuple(got[0]) == (dt.datetime(2027, 1, 1, 7, 30), 2027, 1, 53, 4)
    assert tuple(got[1]) == (None,) * 5
    assert got[2].d == dt.datetime(2026, 5, 4) and got[2].PROD_DOW == 0


def test_week_labels(spark):
    df = spark.createDataFrame([(2026, 5), (None, 5), (2026, None)], "y int, w int")
    got = [tuple(r) for r in df.select(week_label(F.col("y"), F.col("w")), short_week_label(F.col("w"))).collect()]
    assert got == [("2026-W05", "W05"), (None, "W05"), (None, None)]


def test_rounding_and_ratios(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.005,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"), 2)).collect()] == [0.12, 2.68, 1.0]
    pairs = spark.createDataFrame([(1, 3), (1, 0), (None, 2)], "n int, d int")
    got = [tuple(r) for r in pairs.select(ratio(F.col("n"), F.col("d")), ratio_or_zero(F.col("n"), F.col("d"), 2)).collect()]
    assert got == [(33.333, 33.33), (None, 0.0), (None, 0.0)]


def test_bands(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (2.1,), (None,)], "x double")
    assert [r[0] for r in df.select(band(F.col("x"), 0.5, 2)).collect()] == ["good", "warn", "bad", "none"]
    high = spark.createDataFrame([(95.0,), (90.0,), (89.9,)], "x double")
    assert [r[0] for r in high.select(band(F.col("x"), 95, 90, low_is_good=False)).collect()] == ["good", "warn", "bad"]


@pytest.mark.parametrize("text,number", [("12abc", 12.0), ("-3.5kg", -3.5), ("1e3", 1000.0), ("1.", 1.0), ("abc", None), ("", None), (" 5", None)])
def test_leading_number(spark, text, number):
    assert single(spark, [text]).select(leading_number(F.col("x"))).first()[0] == number


def test_natural_keys_order_digit_runs_by_value(spark):
    names = ["R2", "r10", "R1", "Rack 9b", "rack 10a"]
    ordered = [r.x for r in single(spark, names).orderBy(natural_key(F.col("x"))).collect()]
    assert ordered == ["R1", "R2", "r10", "Rack 9b", "rack 10a"]


def test_long_numbers_lose_no_digit(spark):
    ids = ["1234567890123456789012", "1234567890123456789013.0", " -98765432109876543210.5 ", "0000000000000000000012"]
    got = [r["id"] for r in normalized_ids(single(spark, ids), "x", target="id").orderBy("x").collect()]
    assert sorted(got) == sorted(["1234567890123456789012", "1234567890123456789013", "-98765432109876543210", "000012"])
    codes = {r.x: r.c for r in canonical_codes(single(spark, ["1e28", "3e300", "1e-11", "2e-11", "1.23456789012e-5"]), "x", "c").collect()}
    assert codes == {"1e28": "1e+28", "3e300": "3e+300", "1e-11": "1e-11", "2e-11": "2e-11", "1.23456789012e-5": "0.0000123456789012"}


def test_ids_of_any_length_meet_their_other_form(spark):
    long = "1" + "0" * 60 + "12"
    got = [r["id"] for r in normalized_ids(single(spark, [long, long + ".0", " 000" + long + ".", "-" + long + ".5"]), "x", target="id").orderBy("i").collect()]
    assert got == [long] * 3 + ["-" + long]


def test_totals_lose_no_amount(spark):
    add = lambda values, kind="double": single(spark, values, kind).repartition(3).agg(total(F.col("x"))).first()[0]
    assert add([1e-10] * 4) == pytest.approx(4e-10, rel=1e-12)
    assert add([1e-10, 1e-10, 5.0]) == pytest.approx(5.0000000002, rel=1e-15)
    assert add([1e29, 1e29]) == 2e29 and add([1e30, 5.25]) == 1e30
    assert math.isnan(add([float("nan"), 1.0])) and add([float("inf"), 1.0]) == math.inf
    # Decimals that a double only comes near to are added as such.
    assert add([0.1] * 10) == 1.0 and add([0.07 * 31, 0.03 * 7]) == 2.38
    assert add([None, None]) == 0.0 and add([None, 3], "int") == 3.0


def test_natural_keys_of_long_runs(spark):
    ordered = ["x", "x5", "x" + "9" * 35, "x1" + "0" * 35, "x2" + "0" * 35, "y"]
    assert [r.x for r in single(spark, ordered[::-1]).orderBy(natural_key(F.col("x"))).collect()] == ordered


def test_ids_beyond_a_bigint_are_kept(spark):
    numbers = spark.createDataFrame([(1e19,), (-1e19,), (9.3e18,), (12.7,), (float("nan"),), (None,)], "OP_ID double")
    assert [r.OP_ID for r in normalized_ids(numbers).collect()] == ["10000000000000000000", "-10000000000000000000", "9300000000000000000", "000012", None, None]
    texts = spark.createDataFrame([("1e20",), ("1e3",), ("-2.5e19",), ("abc",)], "OP_ID string")
    assert [r.OP_ID for r in normalized_ids(texts).collect()] == ["100000000000000000000", "001000", "-25000000000000000000", "000abc"]
