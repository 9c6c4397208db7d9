"""Exact quantiles against plain ones, through every way a bracket can go."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opquality.operators.quantiles import exact_quantiles, sketch
from opquality.sources.profile import profile

Q = [0.25, 0.5, 0.75]


def expected(values):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    out = []
    for q in Q:
        if not known:
            out.append(None)
            continue
        place = (len(known) - 1) * q
        low, high, part = known[math.floor(place)], known[math.ceil(place)], place - math.floor(place)
        out.append(low if low == high else low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part))
    return out


def found(spark, columns, **options):
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{n}` double" for n in names)).repartition(4).cache()
    known = {n: F.nanvl(F.col(f"`{n}`"), F.lit(None).cast("double")) for n in names}
    row = df.agg(*[x for n, c in known.items() for x in (F.count(c).alias(f"n {n}"), sketch(c, Q).alias(f"q {n}"))]).first()
    return exact_quantiles(df, {n: (row[f"n {n}"], row[f"q {n}"]) for n in names}, Q, **options)


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(3)
    n = 30_000
    columns = {
        "spread": rng.normal(size=n), "third.alike": np.where(rng.random(n) < 0.35, 7.0, rng.normal(7, 3, n)), "whole": rng.integers(0, 40, n).astype(float),
        "two": (rng.random(n) < 0.5).astype(float), "one": np.full(n, 2.5), "infinite": np.where(rng.random(n) < 0.3, math.inf, rng.random(n)),
    }
    plain = {name: [float(v) for v in values] for name, values in columns.items()}
    plain["gaps"] = [None if k % 3 == 0 else math.nan if k % 3 == 1 else float(k * 7919 % 10007) for k in range(n)]
    plain["none"] = [None] * n
    return plain


@pytest.mark.parametrize("kept", [1 << 16, 200, 20])
def test_quantiles_are_exact_however_little_is_kept(spark, columns, kept):
    got = found(spark, columns, kept=kept, accuracy=1000 if kept < 1000 else 10_000)
    assert got == {name: expected(values) for name, values in columns.items()}


def test_a_wrong_sketch_is_noticed(spark):
    values = [float(k) for k in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, {"x": (len(values), [0.0, 10.0, 15_000.0, 16_000.0, 14_999.0, 14_999.5])}, Q, kept=500) == {"x": expected(values)}


def test_two_aggregates_and_nothing_unpivoted(spark, columns, monkeypatch):
    df = spark.createDataFrame([(v, 1, "t") for v in columns["spread"]], "x double, i int, s string")
    jobs = []
    kind = type(df)
    agg, checkpoint = kind.agg, kind.checkpoint
    monkeypatch.setattr(kind, "agg", lambda self, *a: jobs.append("agg") or agg(self, *a))
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: jobs.append("checkpoint") or checkpoint(self, *a, **k))
    got = {r.COLUMN: r for r in profile(df).collect()}
    assert jobs == ["agg", "agg"]
    assert [got["x"].Q25, got["x"].Q50, got["x"].Q75] == expected(columns["spread"])
    assert (got["i"].Q50, got["s"].Q50) == (1.0, None)


def test_an_empty_table_has_no_quartiles(spark):
    got = profile(spark.createDataFrame([], "x double, s string")).collect()
    assert [(r.COLUMN, r.ROWS, r.Q25, r.MEAN) for r in got] == [("x", 0, None, None), ("s", 0, None, None)]
