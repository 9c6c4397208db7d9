"""The operator dimension and the six fact tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.dates import calendar_parts, to_datetime
from opquality.functions.ids import canonical_codes, dimension_key, normalized_ids
from opquality.functions.numbers import nan_to_null
from opquality.operators.filters import since
from opquality.operators.lookup import Lookup, first_per_key, null_safe_left_join
from opquality.sources.columns import col, column_type, first_column, resolve_column, upper_columns
from opquality.sources.readers import Catalog

# Fixed value: production before this date is left out unless told otherwise.
DEFAULT_MIN_PROD_DATE = "2026-05-01"

# What facts take over from the operator dimension.
OPERATOR_COLUMNS = (
    "OP_ID", "CHORUS_ID", "OPERATOR_NAME", "BU", "CREW",
    "SUPERVISOR_CHORUS_ID", "COST_CENTER", "POSITION", "IS_ACTIVE",
)
EVENT_OPERATOR_COLUMNS = ("OP_ID", "OPERATOR_NAME", "BU", "CREW")

# Names the tire count may have, in order of preference.
TIRE_COLUMNS = ("TIRES_BUILT", "TIRES", "TOTAL_TIRES", "2ND_STEP_TIRES", "SECOND_STEP_TIRES")

# Uniformity columns kept, and the names they are published under.
UNIFORMITY_COLUMNS = (
    "BARCODE", "GREENTIRE", "CAI", "TUO", "VENTILATION", "RUN_TYPE", "OGU2_GRADE",
    "UNI_REPAIR", "CQ_CODE", "TEST_DATETIME", "CONFECTION_TIMESTAMP",
    "CONFECTION_MACHINE", "FINISHING_TIMESTAMP", "FINISHING_MACHINE",
    "FINISHING_OPERATOR_ID", "CURING_TIMESTAMP", "CURING_PRESS",
    "CURING_OPERATOR_ID", "MOULD",
)
UNIFORMITY_NAMES = {
    "CONFECTION_MACHINE": "TBM",
    "OGU2_GRADE": "UNI_GRADE",
    "TEST_DATETIME": "TEST_DATE",
    "CQ_CODE": "CQ_CODE_STR",
}


def _stamp(df: DataFrame, name: str, formats: Iterable[str] = ()) -> Column:
    return to_datetime(col(name), column_type(df, name), formats)


def dim_operator(employees: DataFrame, bu: DataFrame, known_only: bool = False) -> DataFrame:
    """Employees with their organisational unit; with ``known_only``, those with an id.

    Nothing is deduplicated, so an operator listed twice in ``bu`` appears
    twice, and missing ids match each other. Columns both sides have are told
    apart by ``_x`` and ``_y``.
    """
    left, right = (normalized_ids(upper_columns(d)) for d in (employees, bu))
    shared_names = [c for c in left.columns if c in right.columns and c != "OP_ID"]
    left = left.withColumnsRenamed({c: c + "_x" for c in shared_names})
    right = right.withColumnsRenamed({c: c + "_y" for c in shared_names} | {"OP_ID": "_BU_OP_ID"})
    if known_only:
        joined = left.where(F.col("OP_ID").isNotNull()).join(right, F.col("OP_ID") == F.col("_BU_OP_ID"), "left")
    else:
        joined = null_safe_left_join(left, right, "OP_ID", "_BU_OP_ID")
    return joined.drop("_BU_OP_ID")


def operator_lookup(dim: DataFrame) -> Lookup:
    """One row per operator id."""
    slim = upper_columns(dim).select(*OPERATOR_COLUMNS)
    slim = slim.withColumn("OP_ID", dimension_key(F.col("OP_ID")))
    return Lookup.of(first_per_key(slim, ["OP_ID"]), "OP_ID")


def code_lookup(codes: DataFrame) -> Lookup:
    """One row per defect code with its description, step and tier."""
    codes = upper_columns(codes)
    relates = resolve_column(codes.columns, exact=("RELATES TO", "RELATES_TO"), required="related step")
    slim = canonical_codes(codes, "CQ").select(
        "CQ_CODE_STR",
        F.col("CQ_CODE_DESCRIPTION").alias("CQ_DESCRIPTION"),
        col(relates).alias("CQ_RELATES_TO"),
        F.col("TYPES").alias("CQ_TYPE_TIER"),
    )
    return Lookup.of(first_per_key(slim, ["CQ_CODE_STR"]), "CQ_CODE_STR")


def _with_operator(facts: DataFrame, operators: Lookup) -> DataFrame:
    names = [c for c in operators.table.columns if c != "OP_ID"]
    clash = [c for c in names if c in facts.columns]
    facts = facts.withColumnsRenamed({c: c + "_x" for c in clash})
    table = operators.table.withColumnsRenamed({c: c + "_y" for c in clash})
    added = [c for c in table.columns if c != "OP_ID"]
    # Rows without an operator are many, their dates are as well.
    joined = Lookup(table, operators.keys).left_join(facts, spread_by=[c for c in ("PROD_DATE",) if c in facts.columns])
    return joined.select(*[col(c) for c in facts.columns], *added)


def _production(
    source: DataFrame,
    operators: Lookup,
    op_column: str,
    date_column: str,
    min_date: str | None,
    formats: Iterable[str],
    day_of_week: bool = False,
) -> DataFrame:
    kept = since(source.withColumn("PROD_DATE", _stamp(source, date_column, formats)), min_date)
    kept = normalized_ids(kept, op_column)
    return _with_operator(kept, operators).withColumns(calendar_parts(F.col("PROD_DATE"), day_of_week))


def fact_first_step(prod: DataFrame, operators: Lookup, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = ()) -> DataFrame:
    """First-step production rows with operator and calendar columns."""
    return _production(upper_columns(prod), operators, "OP_ID", "PROD_DATE", min_date, formats, day_of_week=True)


def fact_second_step(prod: DataFrame, operators: Lookup, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = ()) -> DataFrame:
    """Second-step production; id, date and tire columns are found by name."""
    prod = upper_columns(prod)
    op_column = resolve_column(prod.columns, suffix="OP_ID", default="OP_ID")
    tires = resolve_column(prod.columns, exact=TIRE_COLUMNS, required="tires")
    prod = prod.withColumnRenamed(tires, "TIRES_BUILT")
    date_column = first_column(prod.columns, exact="DATE", contains="PROD_DATE") or "PROD_DATE"
    return _production(prod, operators, op_column, date_column, min_date, formats)


def fact_nc_scrap(scrap: DataFrame, operators: Lookup, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = ()) -> DataFrame:
    """Scrap rows with operator and calendar columns."""
    return _production(upper_columns(scrap), operators, "OP_ID", "PROD_DATE", min_date, formats)


def fact_conf(events: DataFrame, operators: Lookup, codes: Lookup, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = ()) -> DataFrame:
    """Defect events that carry a code, with operator and code description.

    Serves the before-cure and the after-cure table alike. Only three source
    columns are read; rows without a code or too old go before the lookups.
    """
    names = events.columns
    op_column = resolve_column(names, exact=("OP_ID",), suffix="OP_ID", required="operator id")
    code_column = resolve_column(names, exact=("CQ_CODE",), contains=("CQ", "CODE"), required="defect code")
    date_column = first_column(names, exact="DATE", contains="PROD_DATE")
    # A code is missing exactly where its source is, so the test goes to the scan.
    coded = events.where(nan_to_null(col(code_column), column_type(events, code_column)).isNotNull())
    picked = [col(op_column).alias("OP_ID"), col(code_column).alias("CQ_CODE")]
    if date_column:
        picked.append(_stamp(events, date_column, formats).alias("PROD_DATE"))
    kept = since(coded.select(*picked), min_date)
    kept = canonical_codes(normalized_ids(kept, mode="text")).drop("CQ_CODE")
    slim_operators = operators.select(*EVENT_OPERATOR_COLUMNS)
    # All events here have a code.
    fact = codes.left_join(_with_operator(kept, slim_operators))
    columns = [*EVENT_OPERATOR_COLUMNS, "CQ_CODE_STR", "CQ_DESCRIPTION", "CQ_RELATES_TO", "CQ_TYPE_TIER"]
    if date_column:
        fact = fact.withColumns(calendar_parts(F.col("PROD_DATE")))
        columns += ["PROD_DATE", "PROD_YEAR", "PROD_MONTH", "PROD_WEEK"]
    return fact.select(*columns)


def rft_flag(df: DataFrame, grade: str | None) -> Column:
    """1 for a normal run without a defect grade; 0 where columns are missing."""
    if grade not in df.columns or "RUN_TYPE" not in df.columns:
        return F.lit(0)
    passed = (F.col("RUN_TYPE") == "N") & F.col(grade).isNull()
    return F.when(F.coalesce(passed, F.lit(False)), 1).otherwise(0)


def repair_flag(df: DataFrame) -> Column:
    return F.col("UNI_REPAIR").isNotNull().cast("int") if "UNI_REPAIR" in df.columns else F.lit(0)


def _optional_stamp(df: DataFrame, name: str, formats: Iterable[str]) -> Column:
    return _stamp(df, name, formats) if name in df.columns else F.lit(None).cast(T.TimestampNTZType())


def fact_uniformity(tests: DataFrame, operators: Lookup, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = ()) -> DataFrame:
    """One row per uniformity test, credited to the operator who built the tire
    and dated by the build, or by the test where the build time is missing."""
    tests = upper_columns(tests)
    kept = [c for c in UNIFORMITY_COLUMNS if c in tests.columns]
    slim = normalized_ids(tests, "CONFECTION_OPERATOR_ID").select("OP_ID", *kept).withColumnsRenamed(UNIFORMITY_NAMES)
    slim = slim.withColumns(
        {
            "IS_RFT": rft_flag(slim, "UNI_GRADE"),
            "IS_REPAIRED": repair_flag(slim),
            "CONFECTION_TIMESTAMP": _optional_stamp(slim, "CONFECTION_TIMESTAMP", formats),
            "TEST_DATE": _optional_stamp(slim, "TEST_DATE", formats),
        }
    )
    built = F.coalesce(F.col("CONFECTION_TIMESTAMP"), F.col("TEST_DATE"))
    dated = slim.withColumns({"PROD_DATE": F.to_date(built)} | calendar_parts(built))
    return _with_operator(since(dated, min_date), operators)


class Star:
    """All tables of the star schema over one catalog, each built on first use."""

    def __init__(
        self, catalog: Catalog, min_date: str | None = DEFAULT_MIN_PROD_DATE, formats: Iterable[str] = (),
        published_dim: DataFrame | None = None,
    ):
        self.catalog = catalog
        self.options = {"min_date": min_date, "formats": tuple(formats)}
        self.published_dim = published_dim

    @cached_property
    def dim_operator(self) -> DataFrame:
        if self.published_dim is not None:
            return self.published_dim
        return dim_operator(self.catalog.read("view_employee"), self.catalog.read("BU_data"))

    @cached_property
    def operators(self) -> Lookup:
        """A row without an id meets no fact, so the lookup is built without these."""
        if self.published_dim is not None:
            return operator_lookup(upper_columns(self.published_dim).where(F.col("OP_ID").isNotNull()))
        return operator_lookup(dim_operator(self.catalog.read("view_employee"), self.catalog.read("BU_data"), known_only=True))

    @cached_property
    def codes(self) -> Lookup:
        return code_lookup(self.catalog.read_first_available("meta_cq_descriptions", "TBM6"))

    @cached_property
    def fact_first_step(self) -> DataFrame:
        return fact_first_step(self.catalog.read("first_step_prod"), self.operators, **self.options)

    @cached_property
    def fact_second_step(self) -> DataFrame:
        return fact_second_step(self.catalog.read("second_step_prod"), self.operators, **self.options)

    @cached_property
    def fact_conf_bc(self) -> DataFrame:
        return fact_conf(self.catalog.read("conf_bc_grq2"), self.operators, self.codes, **self.options)

    @cached_property
    def fact_conf_ac(self) -> DataFrame:
        return fact_conf(self.catalog.read("conf_ac_grq2"), self.operators, self.codes, **self.options)

    @cached_property
    def fact_nc_scrap(self) -> DataFrame:
        return fact_nc_scrap(self.catalog.read("nc_scrap"), self.operators, **self.options)

    @cached_property
    def fact_uniformity(self) -> DataFrame:
        return fact_uniformity(self.catalog.read("uniformity_breakdown"), self.operators, **self.options)
