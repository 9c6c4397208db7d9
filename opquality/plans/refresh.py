"""Batch build of every table the reports read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame

from opquality.operators.filters import CONFECTION, FINISHING
from opquality.plans import aggregates as agg
from opquality.plans.star import DEFAULT_MIN_PROD_DATE, Star
from opquality.sources.buckets import write_bucketed
from opquality.sources.readers import Catalog
from opquality.sources.snapshots import latest, publish, run_folder

FACTS = ("fact_first_step", "fact_second_step", "fact_conf_bc", "fact_conf_ac", "fact_nc_scrap", "fact_uniformity")
PARTITION_COLUMNS = ("PROD_YEAR", "PROD_WEEK")


class RefreshFailed(Exception):
    """Some tables could not be built; the others were."""

    def __init__(self, failures: dict[str, str]):
        super().__init__("refresh failed for: " + ", ".join(failures))
        self.failures = failures


def _write(df: DataFrame, path: str, partitioned: bool) -> None:
    # Rows of a week go to the same files; rebalancing splits a heavy week
    # over several tasks and merges light ones.
    if partitioned:
        df.hint("rebalance", *PARTITION_COLUMNS).write.partitionBy(*PARTITION_COLUMNS).parquet(path)
    else:
        df.write.parquet(path)


def refresh(
    sources: Catalog, out: Catalog, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = (),
    partition_facts: bool = True, period_tables: bool = False,
) -> list[str]:
    """Builds dimension, facts and aggregates in dependency order into ``out``.

    Each step reads what earlier steps of this run wrote. A table that fails does not
    stop the others, but those that read it are not built from an old one: they fail
    too. At the end all tables built become current in one step, those that failed stay
    as they were, and all failures are raised together. A run that ends before leaves
    what is current untouched. The period aggregates, superseded by the operator-by-week
    tables, are optional; for them the tests are stored once in buckets of the barcode.
    """
    options = {"min_date": min_date, "formats": formats}
    spark, run = out.spark, uuid4().hex
    since = latest(spark, out.root)
    own: dict[str, DataFrame] = {}

    @cache
    def star() -> Star:
        return Star(sources, published_dim=own["dim_operator"], **options)

    @cache
    def tests() -> DataFrame:
        source = agg.test_columns(sources.read("uniformity_breakdown"))
        return write_bucketed(source, out.path(run_folder(run, "tests_by_barcode")), "BARCODE") if "BARCODE" in source.columns else source

    def of(build: Callable[..., DataFrame], *inputs: str) -> tuple[Callable[[], DataFrame], tuple[str, ...]]:
        return lambda: build(*[own[i] for i in inputs]), inputs

    first, second, bc, ac, scrap, uni = FACTS
    steps: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...]]] = {"dim_operator": (lambda: Star(sources, **options).dim_operator, ())}
    steps |= {name: (lambda name=name: getattr(star(), name), ("dim_operator",)) for name in FACTS}
    steps |= {
        "agg_donut_bc": of(agg.agg_donut, bc),
        "agg_donut_ac": of(agg.agg_donut, ac),
        "agg_donut_scrap": of(agg.agg_donut_scrap, scrap),
        "agg_op_week": of(agg.agg_op_week, first, bc, ac, scrap, uni),
        "agg_op_week_fin": of(agg.agg_op_week_fin, second, bc, ac, scrap, uni),
    }
    if period_tables:
        steps |= {
            "agg_kpi_summary": of(agg.agg_kpi_summary, first, bc, ac, scrap),
            "agg_weekly_trend": of(agg.agg_weekly_trend, "agg_kpi_summary"),
            "agg_weekly_trend_fin": of(agg.agg_weekly_trend_fin, second, bc, ac),
            "agg_uniformity": (lambda: agg.agg_uniformity(tests(), star().operators, CONFECTION, by_barcode=True), ("dim_operator",)),
            "agg_uniformity_fin": (lambda: agg.agg_uniformity(tests(), star().operators, FINISHING, by_barcode=True), ("dim_operator",)),
            "agg_top_performers": of(agg.agg_top_performers, first, bc, ac, scrap),
            "agg_top_performers_fin": of(agg.agg_top_performers_fin, second, bc, ac, scrap, uni),
        }
    built, failures = [], {}
    for name, (build, inputs) in steps.items():
        missing = [i for i in inputs if i in failures]
        if missing:
            failures[name] = "not built, for want of " + ", ".join(missing)
            continue
        try:
            path = out.path(run_folder(run, name))
            _write(build(), path, partition_facts and name in FACTS)
            own[name] = spark.read.parquet(path)
            built.append(name)
        except Exception as problem:  # whatever stops a step, the others go on
            failures[name] = f"{type(problem).__name__}: {problem}"
    if built:
        publish(spark, out.root, run, built, since)
        out.renew()
    if failures:
        raise RefreshFailed(failures)
    return built
