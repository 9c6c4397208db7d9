"""Table profiles and fact diagnostics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.operators.quantiles import exact_quantiles, sketch
from opquality.operators.topk import top
from opquality.sources.columns import col
from opquality.sources.readers import Catalog

QUARTILES = {"Q25": 0.25, "Q50": 0.5, "Q75": 0.75}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, values, a sample value, and for numbers
    mean, standard deviation, extremes and exact quartiles (linear interpolation).

    Runs when called: one aggregate gives all figures and brackets the quartiles, a second
    counts and keeps what lies inside the brackets (``operators/quantiles.py``).
    """
    numeric = set(_numeric(df))
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(df.columns):
        aggregates += [F.count(col(name)).alias(f"n{i}"), F.min(col(name)).cast("string").alias(f"s{i}")]
        if name in numeric:
            number = col(name).cast("double")
            known = F.nanvl(number, F.lit(None).cast("double"))
            aggregates += [
                F.avg(number).alias(f"m{i}"), F.stddev(number).alias(f"d{i}"), F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"),
                F.count(known).alias(f"k{i}"), sketch(known, list(QUARTILES.values())).alias(f"q{i}"),
            ]
    one = df.agg(*aggregates).first()
    sketches = {name: (one[f"k{i}"], one[f"q{i}"]) for i, name in enumerate(df.columns) if name in numeric}
    quartiles = exact_quantiles(df, sketches, list(QUARTILES.values())) if sketches else {}
    rows = []
    for i, field in enumerate(df.schema.fields):
        figures = [one[f"{k}{i}"] for k in "mdlh"] if field.name in numeric else [None] * 4
        rows.append((field.name, field.dataType.simpleString(), one["_rows"], one[f"n{i}"], one[f"s{i}"], *figures, *quartiles.get(field.name, [None] * 3)))
    figures = ", ".join(f"{name} double" for name in ("MEAN", "STD", "MIN", "MAX", *QUARTILES))
    return df.sparkSession.createDataFrame(rows, f"COLUMN string, TYPE string, ROWS long, VALUES long, SAMPLE string, {figures}")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def profile_tables(catalog: Catalog, names: Iterable[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Profiles of the readable tables and the reasons why others are not."""
    profiles, problems = {}, {}
    for name in names:
        try:
            profiles[name] = profile(catalog.read(name))
        except AnalysisException as problem:
            problems[name] = str(problem)
    return profiles, problems


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values, the missing one included."""
    counts = df.groupBy(col(column).cast("string").alias("VALUE")).agg(F.count(F.lit(1)).alias("ROWS"))
    return top(counts, n, F.desc("ROWS"), F.asc_nulls_last("VALUE"))


def fact_diagnostics(fact: DataFrame) -> DataFrame:
    """Row and match counts, date range and flag means of a fact, in one pass.

    The distinct tires of a uniformity fact are counted as well.
    """
    checks = [F.count(F.lit(1)).alias("ROWS")]
    if "OPERATOR_NAME" in fact.columns:
        checks.append(F.count("OPERATOR_NAME").alias("WITH_OPERATOR"))
    if "BU" in fact.columns:
        checks.append(F.count("BU").alias("WITH_BU"))
    for flag in ("IS_RFT", "IS_REPAIRED"):
        if flag in fact.columns:
            checks += [F.sum(flag).alias(flag + "_COUNT"), F.avg(flag).alias(flag + "_MEAN")]
    if "PROD_DATE" in fact.columns:
        checks += [F.min("PROD_DATE").alias("FIRST_DATE"), F.max("PROD_DATE").alias("LAST_DATE")]
    if "BARCODE" in fact.columns:
        checks.append(F.count_distinct("BARCODE").alias("TIRES"))
    return fact.agg(*checks)
