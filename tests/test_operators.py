"""Building blocks: lookups, combinations, scores, numbering, top-k, filters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opquality.operators.filters import Filters, day_ranges, of_step, of_step_or_all, since
from opquality.operators.lookup import Lookup, first_per_key, null_safe_left_join
from opquality.operators import measures
from opquality.operators.measures import AMOUNT, COUNT, combine, combine_onto, best_per_item, with_share_of_total
from opquality.operators.numbering import Ranges, SortKey, dense_numbers
from opquality.operators.scoring import scored_and_ranked
from opquality.operators.topk import top_with_other
from opquality.functions.numbers import total


def test_first_per_key_is_independent_of_row_order(spark, rows):
    data = [("a", 2, "x"), ("a", None, "y"), ("a", 1, "z"), (None, 5, "n"), (None, 4, "m")]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k string, o int, v string").repartition(3)
        assert rows(first_per_key(df, ["k"], ["o"])) == [("a", 1, "z"), (None, 4, "m")]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_lookup_gives_the_same_rows_broadcast_or_not(spark, rows, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        facts = spark.range(400).selectExpr("CASE WHEN id < 50 THEN 'a' WHEN id = 51 THEN 'b' WHEN id = 52 THEN 'c' END AS k", "id AS n").repartition(5)
        side = Lookup.of(spark.range(2).selectExpr("CASE id WHEN 0 THEN 'a' ELSE 'b' END AS k", "CASE id WHEN 0 THEN 'A' ELSE 'B' END AS v"), "k")
        joined = side.left_join(facts)
        assert joined.count() == 400
        assert rows(joined.where("n between 49 and 52")) == [("a", 49, "A"), ("b", 51, "B"), ("c", 52, None), (None, 50, None)]
        # rows without a key are dealt to many places, not to one
        assert joined.where("k is null").count() == 348
        spread = side.left_join(facts, spread_by=["n"])
        assert rows(spread) == rows(joined) and "_place" not in spread.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_building_a_join_starts_no_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "lookup-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        Lookup.of(spark.range(100).selectExpr("id AS k", "id AS v"), "k").left_join(spark.range(1000).selectExpr("id AS k"))
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def random_measure(spark, rng, name, kind):
    ids = ["a", "b", "c", None]
    number = float if kind == "double" else int
    data = [(rng.choice(ids), rng.choice([1, 2, None]), number(rng.randint(0, 9))) for _ in range(40)]
    df = spark.createDataFrame(data, f"k string, w int, {name} {kind}")
    return df.groupBy("k", "w").agg(F.sum(name).alias(name))


def test_combine_equals_chained_null_safe_outer_joins(spark, rows):
    rng = random.Random(7)
    parts = [random_measure(spark, rng, n, t) for n, t in (("p", "bigint"), ("q", "bigint"), ("r", "double"))]
    measures = {"p": COUNT, "q": COUNT, "r": AMOUNT}
    chained = parts[0]
    for part in parts[1:]:
        right = part.withColumnsRenamed({"k": "k2", "w": "w2"})
        on = F.col("k").eqNullSafe(F.col("k2")) & F.col("w").eqNullSafe(F.col("w2"))
        hit = part.columns[-1]
        joined = chained.withColumn("l", F.lit(1)).join(right.withColumn("h", F.lit(1)), on, "full")
        keys = [F.when(F.col("l").isNull(), F.col(c + "2")).otherwise(F.col(c)).alias(c) for c in ("k", "w")]
        chained = joined.select(*keys, *chained.columns[2:], hit)
    assert rows(combine(parts, ["k", "w"], measures)) == rows(chained.fillna(0, ["p", "q", "r"]))


def test_combine_onto_keeps_base_keys_only(spark, rows):
    base = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, p double")
    other = spark.createDataFrame([("a", 5), (None, 6), ("b", 7)], "k string, q bigint")
    got = combine_onto(base, [other], ["k"], {"p": AMOUNT, "q": COUNT})
    assert rows(got) == [("a", 1.0, 5), (None, 2.0, 6)]


def test_a_missing_item_adds_its_flag_but_is_not_counted(spark, rows):
    tests = spark.createDataFrame([("o", 1, 0), ("o", 1, 1), ("o", 2, 0), ("o", None, 1), ("o", None, 1)], "k string, item int, flag int")
    once = best_per_item(tests, ["k"], "item", "flag").groupBy("k").agg(F.sum("UNI_TESTED"), F.sum("UNI_RFT"))
    assert rows(once) == [("o", 2, 2)]


def test_shares_are_missing_for_incomplete_slices(spark, rows):
    cells = spark.createDataFrame([("E", 1, 1.0), ("E", 1, 3.0), ("E", None, 5.0), (None, 1, 7.0)], "bu string, crew int, v double")
    got = with_share_of_total(cells, "v", total, ["bu", "crew"], "t", "pct")
    assert rows(got, "v", "t", "pct") == [(1.0, 4.0, 25.0), (3.0, 4.0, 75.0), (5.0, None, None), (7.0, None, None)]


def scores(spark, data, partitions):
    df = spark.createDataFrame(data, "op string, TIRES_BUILT double, a double, b double").repartition(partitions)
    return scored_and_ranked(df, {"x": F.coalesce("a", F.lit(0.0)), "y": F.coalesce("b", F.lit(0.0))})


def test_scores_use_all_rows_but_rank_only_the_rankable(spark):
    data = [("u", 500.0, 1.0, 7.0), ("v", 500.0, 2.0, 7.0), ("w", 500.0, 2.0, 7.0), ("s", 50.0, 3.0, 7.0), ("z", 500.0, None, 7.0)]
    for partitions in (1, 4):
        got = {r.op: (r.x, r.y, r.QUALITY_SCORE, r.RANKABLE, r.RANK) for r in scores(spark, data, partitions).collect()}
        # the constant term is 0; the unranked "s" still sets the maximum
        assert got == {
            "z": (0.0, 0.0, 0.0, True, 1), "u": (1 / 3, 0.0, 16.67, True, 2), "v": (2 / 3, 0.0, 33.33, True, 3),
            "w": (2 / 3, 0.0, 33.33, True, 3), "s": (1.0, 0.0, 50.0, False, None),
        }


def test_ranks_equal_a_plain_competition_ranking(spark):
    rng = random.Random(3)
    data = [(str(i), rng.choice([50.0, 200.0]), float(rng.randint(0, 40)), 0.0) for i in range(400)]
    got = scores(spark, data, 6).collect()
    ranked = sorted(r.QUALITY_SCORE for r in got if r.RANKABLE)
    assert all(r.RANK == (ranked.index(r.QUALITY_SCORE) + 1 if r.RANKABLE else None) for r in got)


def test_dense_numbers_follow_the_order_and_survive_equal_rows(spark):
    data = [("same",)] * 300 + [(f"v{i:03d}",) for i in range(100)]
    df = spark.createDataFrame(data, "v string").repartition(7)
    got = dense_numbers(df, [SortKey("v")]).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1, 401))
    assert [r.v for r in got] == sorted(v for v, in data)


def test_dense_numbers_without_order_shuffle_nothing(spark):
    df = spark.range(100).repartition(5)
    got = dense_numbers(df.withColumn("row_id", F.lit(9)), start=11)
    assert got.columns == ["row_id", "id"]
    assert sorted(r.row_id for r in got.collect()) == list(range(11, 111))


@pytest.fixture(scope="module")
def unordered(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, None, "a", "b", "é", "Z"]), rng.choice([None, 1.5, -2.0, 7.0]), n) for n in range(700)]
    return spark.createDataFrame(data, "t string, x double, n int").repartition(6)


ORDERS = [
    ([SortKey("t"), SortKey("n")], ["t asc nulls last", "n"]), ([SortKey("t", True, True), SortKey("x"), SortKey("n", True)], ["t desc nulls first", "x asc nulls last", "n desc"]),
    ([SortKey("x", nulls_first=True), SortKey("t", True), SortKey("n")], ["x asc nulls first", "t desc nulls last", "n"]),
]


@pytest.mark.parametrize("keys,sql", ORDERS)
def test_numbers_and_pages_follow_any_order(spark, unordered, keys, sql, monkeypatch):
    kind = type(unordered)
    monkeypatch.setattr(kind, "checkpoint", lambda *a, **k: pytest.fail("rows are stored"))
    unordered.createOrReplaceTempView("unordered")
    expected = [tuple(r) for r in spark.sql(f"SELECT * FROM unordered ORDER BY {', '.join(sql)}").collect()]
    ranges = Ranges(unordered, keys, 16)
    assert len(ranges.splitters) > 8 and ranges.offsets[-1] == 700
    assert [tuple(r)[1:] for r in ranges.numbered("place").orderBy("place").collect()] == expected
    for offset, limit in ((0, 10), (333, 50), (690, 50), (700, 5), (9000, 5)):
        page = ranges.page(offset, limit, "place").orderBy("place").collect()
        assert [(r.place, (r.t, r.x, r.n)) for r in page] == [(offset + k + 1, row) for k, row in enumerate(expected[offset:offset + limit])]


def test_a_page_sorts_only_the_ranges_it_lies_in(spark, unordered):
    ranges = Ranges(unordered, [SortKey("n")], 16)
    asked = ranges.rows.where(F.col("_range").isin([i for i in range(16) if ranges.offsets[i] < 360 and ranges.offsets[i + 1] > 350]))
    assert asked.count() < 150 and ranges.page(350, 10).count() == 10


def test_equal_rows_spread_over_ranges(spark):
    df = spark.createDataFrame([("same", n) for n in range(500)] + [(f"v{n}", n) for n in range(100)], "v string, n int").repartition(5)
    ranges = Ranges(df, [SortKey("v")], 8)
    assert max(b - a for a, b in zip(ranges.offsets, ranges.offsets[1:])) < 250
    assert sorted(x.k for x in ranges.numbered("k").collect()) == list(range(1, 601))
    assert dense_numbers(df.limit(0), [SortKey("v")]).count() == 0


def test_top_with_other(spark, rows):
    data = [(f"c{i}", 10 - i) for i in range(8)] + [("Other", 100)]
    got = top_with_other(spark.createDataFrame(data, "c string, v int"), "c", "v", 3)
    assert rows(got) == [("Other", False, 100), ("Other", True, 33), ("c0", False, 10), ("c1", False, 9)]
    small = top_with_other(spark.createDataFrame([("a", 1), ("b", 0)], "c string, v int"), "c", "v", 1)
    assert rows(small) == [("a", False, 1)]


def test_filters_ignore_absent_columns_and_cast_values(spark, rows):
    df = spark.createDataFrame([("E", 1.0, 7, "000001"), ("A", 2.0, 8, "000002"), (None, 1.0, 7, "000003")], "BU string, CREW double, WEEK int, OP_ID string")
    assert rows(Filters(crews=[1], weeks=[7]).apply(df), "OP_ID") == [("000001",), ("000003",)]
    assert rows(Filters(bus=["A"]).apply(df), "OP_ID") == [("000002",)]
    assert rows(Filters(op_id="000003").apply(df, known_bu_only=True), "OP_ID") == []
    assert Filters(years=[2026]).apply(df).count() == 3


def test_step_filters(spark):
    df = spark.createDataFrame([(" finishing ",), ("Confection",), (None,)], "CQ_RELATES_TO string")
    assert of_step(df, "Finishing").count() == 1
    assert of_step(df.withColumnRenamed("CQ_RELATES_TO", "x"), "Finishing").count() == 3
    assert of_step_or_all(df, "Finishing").count() == 1
    assert of_step_or_all(df, "Curing").count() == 3


def test_minimum_date_drops_missing_dates(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2026-05-01'), (timestamp_ntz'2026-04-30'), (NULL) AS t(PROD_DATE)")
    assert since(df, "2026-05-01").count() == 1 and since(df, None).count() == 3


def test_missing_keys_match_each_other_in_blocks(spark, rows):
    left = spark.createDataFrame([(None, n) for n in range(20)] + [("a", 20), ("a", 21), ("b", 22)], "k string, n int")
    right = spark.createDataFrame([(None, m) for m in range(30)] + [("a", 30), ("a", 31)], "k2 string, m int")
    got = null_safe_left_join(left, right, "k", "k2")
    assert rows(got) == rows(left.join(right, left.k.eqNullSafe(right.k2), "left"))
    assert rows(null_safe_left_join(left, right.where("k2 = 'a'"), "k", "k2")) == rows(left.join(right.where("k2 = 'a'"), left.k.eqNullSafe(right.k2), "left"))
    missing = null_safe_left_join(left.where("k is null"), right, "k", "k2")
    assert missing.count() == 600
    # no task joins all of them
    sizes = everywhere_sizes(missing)
    assert max(sizes) < 600


def everywhere_sizes(df):
    return [r["count"] for r in df.groupBy(F.pmod(F.xxhash64("k2", "m"), F.lit(32))).count().collect()]


def test_days_of_weeks_and_years():
    assert day_ranges([2026], [19]) == [(dt.date(2026, 5, 4), dt.date(2026, 5, 11))]
    assert day_ranges([2026], [1, 53]) == [(dt.date(2026, 1, 1), dt.date(2026, 1, 5)), (dt.date(2026, 12, 28), dt.date(2027, 1, 1))]
    assert day_ranges([2025, 2024]) == [(dt.date(2024, 1, 1), dt.date(2026, 1, 1))]
    days = {d for a, b in day_ranges([2021, 2022], [1, 52, 53]) for d in (a + dt.timedelta(k) for k in range((b - a).days))}
    assert days == {d for d in (dt.date(2021, 1, 1) + dt.timedelta(k) for k in range(730)) if d.isocalendar().week in (1, 52, 53)}


def test_rows_of_fine_keys_are_dealt_by_the_size_of_their_files(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "a b=%41[1]")
    spark.range(4000).selectExpr("CASE WHEN id % 7 > 0 THEN id DIV 2 END AS k", "id % 3 AS w", "id / 8 AS x").repartition(3).write.parquet(path)
    data = spark.read.option("__globPaths__", "false").parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "a b=%41[1]").glob("*.parquet"))
    monkeypatch.setattr(measures, "BYTES_A_PLACE", size // 8)
    parts = [data.select("k", "w", "x"), data.select("k", "w", F.lit(1).cast("long").alias("n"))]
    # more input, more tasks, whatever the number of cores
    assert measures.dealt(parts, ["k", "w"]).rdd.getNumPartitions() in (16, 17)
    kinds = {"x": AMOUNT, "n": COUNT}
    fine = combine(parts, ["k", "w"], kinds, fine=True)
    assert rows(fine) == rows(combine(parts, ["k", "w"], kinds))
    # rows from no file
    own = [spark.createDataFrame([(None, 1, 2.5), (None, 1, None), (3, None, 0.25)], "k long, w long, x double")]
    assert rows(combine(own, ["k", "w"], {"x": AMOUNT}, fine=True)) == rows(combine(own, ["k", "w"], {"x": AMOUNT}))
    once = best_per_item(data.withColumn("f", F.lit(1.0)), ["w"], "k", "f")
    assert once.count() == data.select("w", "k").distinct().count() and once.rdd.getNumPartitions() >= 8
