"""The inspection log: cleaning, row ids, grid queries, change sets and saving them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.numbers import to_number
from opquality.functions.text import (
    CLOSED, blank_to_null, contains_ignoring_case, is_blank, leading_number, natural_key, status_of,
)
from opquality.operators.numbering import Ranges, SortKey, dense_numbers
from opquality.operators.topk import top, with_position
from opquality.sources.columns import col
from opquality.sources.readers import as_text

# The text columns of the log, in order.
LOG_COLUMNS = (
    "RACK ID",
    "Date (START HERE)",
    "Release/Repair Removal Date < 10 days",
    "Person Responsible for Disposition",
    "Person Entering in Product or Rack",
    "Quantity",
    "Tire Code(s)",
    "CQ or Condition",
    "Location (cage / overflow)",
    "Disposition",
    "Max. Date For Recoup <30 days",
    "Comments / Notes",
    "Person Removing Product or Rack",
    "Date Removed",
)
KEY, STATUS, DATE_REMOVED = "row_id", "Status", "Date Removed"


def clean_log(log: DataFrame, date_removed: str = DATE_REMOVED, carry: Sequence[str] = ()) -> DataFrame:
    """Drops rows that are blank throughout, strips text, blanks to NULL, adds
    the status. Dates stay text: they carry no year.

    ``carry`` names columns, such as a line number, that are passed through and
    do not make a row count as filled.
    """
    content = [c for c in log.columns if c not in carry]
    text = [blank_to_null(col(c).cast("string")).alias(c) for c in content]
    kept = log.select(*[col(c) for c in carry], *text).dropna(how="all", subset=[f"`{c}`" for c in content])
    return kept.withColumn(STATUS, status_of(col(date_removed))) if date_removed in content else kept


def clean_report(log: DataFrame, date_removed: str = DATE_REMOVED, carry: Sequence[str] = ()) -> DataFrame:
    """Rows read, dropped and kept, and how many of them are closed or open."""
    blank = reduce(lambda a, b: a & b, [is_blank(col(c).cast("string")) for c in log.columns if c not in carry])
    closed = status_of(col(date_removed)) == CLOSED
    return log.select(blank.alias("_blank"), closed.alias("_closed")).agg(
        F.count(F.lit(1)).alias("INPUT_ROWS"),
        F.count_if(F.col("_blank")).alias("DROPPED"),
        F.count_if(~F.col("_blank")).alias("OUTPUT_ROWS"),
        F.count_if(~F.col("_blank") & F.col("_closed")).alias("CLOSED_ROWS"),
        F.count_if(~F.col("_blank") & ~F.col("_closed")).alias("OPEN_ROWS"),
    )


def add_row_id(log: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """``row_id`` 1..N as the first column, replacing any it had."""
    return dense_numbers(log, [SortKey(c) for c in order_by], KEY)


def suggestions(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct values per column, most frequent first; with a limit, only of columns
    that have at most so many of them."""
    text = as_text(log)
    values = text.select(*[blank_to_null(col(c)).alias(c) for c in text.columns])
    cells = values.unpivot([], [col(c) for c in values.columns], "COLUMN", "VALUE").where(F.col("VALUE").isNotNull())
    counts = cells.groupBy("COLUMN", "VALUE").agg(F.count(F.lit(1)).alias("FREQUENCY"))
    if limit is not None:
        # one row per column of the log
        short = counts.groupBy("COLUMN").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= limit).select("COLUMN")
        counts = counts.join(F.broadcast(short), "COLUMN")
    return counts.orderBy("COLUMN", F.desc("FREQUENCY"), "VALUE")


def distinct_counts(log: DataFrame, names: Iterable[str]) -> dict[str, int]:
    """Distinct filled values of some columns, for a caller that chooses which of them
    to filter by exact value."""
    asked = [n for n in names if n in log.columns]
    counts = suggestions(log.select(*[col(n) for n in asked])).groupBy("COLUMN").count().collect() if asked else []
    return {n: 0 for n in asked} | {r["COLUMN"]: r["count"] for r in counts}


def _shown_text(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def grid_predicate(log: DataFrame, column_filters: Mapping[str, str] | None = None, search: str = "", exact: Iterable[str] = (STATUS,), key: str = KEY) -> Column:
    """True for rows matching every column filter and, in some visible column,
    the search.

    The columns in ``exact`` compare by their whole text, the others by
    case-insensitive containment, however many values they have.
    """
    wanted = {n: v.strip() for n, v in (column_filters or {}).items() if v and v.strip()}
    chosen = set(exact)
    tests = [F.lit(True)]
    for name, value in wanted.items():
        text = _shown_text(name)
        tests.append(text == value if name in chosen else contains_ignoring_case(text, value))
    needle = search.strip()
    if needle:
        hits = [contains_ignoring_case(_shown_text(c), needle) for c in log.columns if c != key]
        tests.append(reduce(lambda a, b: a | b, hits))
    return reduce(lambda a, b: a & b, tests)


def grid_filter(log: DataFrame, column_filters: Mapping[str, str] | None = None, search: str = "", exact: Iterable[str] = (STATUS,), key: str = KEY) -> DataFrame:
    return log.where(grid_predicate(log, column_filters, search, exact, key))


def natural_keys(name: str) -> dict[str, Column]:
    """Sort keys of a column: blank, leading number, natural text, text."""
    text = _shown_text(name)
    return {"_blank": text == "", "_number": leading_number(text), "_natural": natural_key(text), "_text": text}


def natural_order(descending: bool = False) -> list[SortKey]:
    """Blanks last either way; numbers by value, before other text, digit runs
    in text by value."""
    return [SortKey("_blank"), SortKey("_number", descending, nulls_first=descending), SortKey("_natural", descending), SortKey("_text", descending)]


def grid_query(
    log: DataFrame, column_filters: Mapping[str, str] | None = None, search: str = "", sort: str | None = None,
    descending: bool = False, limit: int | None = None, exact: Iterable[str] = (STATUS,), key: str = KEY, offset: int = 0,
) -> DataFrame:
    """The matching rows in order, numbered from 1; ties keep key order. With a
    limit, the page of so many rows after the first ``offset`` ones.

    Sort keys are columns: as expressions they would be redone per comparison. All
    rows are numbered by ranges, the first page by a window over it, and a later page
    by sorting only the ranges that it lies in.
    """
    rows = grid_filter(log, column_filters, search, exact, key)
    keys = natural_keys(sort) if sort else {}
    order = (natural_order(descending) if sort else []) + [SortKey(key, nulls_first=True)]
    keyed = rows.withColumns(keys)
    if limit is None:
        numbered = dense_numbers(keyed, order, "POSITION")
        numbered = numbered.where(F.col("POSITION") > offset) if offset else numbered
    elif offset:
        numbered = Ranges(keyed, order).page(offset, limit)
    else:
        columns = [k.order() for k in order]
        numbered = with_position(top(keyed, limit, *columns), *columns)
    return numbered.select(*[col(c) for c in rows.columns], "POSITION")


def grid_counts(
    log: DataFrame, column_filters: Mapping[str, str] | None = None, search: str = "", limit: int | None = None,
    exact: Iterable[str] = (STATUS,), key: str = KEY,
) -> DataFrame:
    """How many rows match, are shown and exist, in one pass."""
    counts = log.agg(
        F.count_if(grid_predicate(log, column_filters, search, exact, key)).alias("MATCHED"),
        F.count(F.lit(1)).alias("TOTAL"),
    )
    shown = F.col("MATCHED") if limit is None else F.least(F.col("MATCHED"), F.lit(limit).cast("long"))
    return counts.withColumn("SHOWN", shown)


def _values(changes: DataFrame, base: DataFrame, key: str, status: str, date_removed: str) -> dict[str, Column]:
    """New column values of a change row: blanks and absent columns are NULL,
    the status is always derived."""
    values = {}
    for field in base.schema.fields:
        name = field.name
        if name == key:
            continue
        if name == status:
            removed = col(date_removed).cast("string") if date_removed in changes.columns else F.lit(None).cast("string")
            values[name] = status_of(removed)
        elif name in changes.columns:
            text = col(name).cast("string")
            values[name] = F.when(~is_blank(text), text).cast(field.dataType)
        else:
            values[name] = F.lit(None).cast(field.dataType)
    return values


def key_number(column: Column, data_type: T.DataType) -> Column:
    """Whole part of a key given as text or number; NULL when it is neither."""
    if isinstance(data_type, T.IntegralType):
        return column.cast("long")
    return to_number(column, data_type).try_cast("long")


def numbered_inserts(
    inserts: DataFrame, columns: DataFrame, next_id: Column | int, key: str = KEY, order: str = "seq", status: str = STATUS, date_removed: str = DATE_REMOVED,
) -> DataFrame:
    """New rows in the columns of the log, with the ids from ``next_id`` on in ``order``."""
    values = _values(inserts, columns, key, status, date_removed)
    new = inserts.select(col(order).alias("_order"), *[v.alias(n) for n, v in values.items()])
    numbered = dense_numbers(new, [SortKey("_order", nulls_first=True)], "_new_id", next_id)
    return numbered.select(*[F.col("_new_id").cast(columns.schema[key].dataType).alias(key) if c == key else col(c) for c in columns.columns])


def keyed_updates(
    updates: DataFrame, columns: DataFrame, key: str = KEY, order: str = "seq", status: str = STATUS, date_removed: str = DATE_REMOVED,
) -> DataFrame:
    """_key, _order and _row, the new values of a row, for updates whose key is a number."""
    values = _values(updates, columns, key, status, date_removed)
    return updates.select(
        key_number(col(key), updates.schema[key].dataType).alias("_key"), col(order).alias("_order"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("_row"),
    ).where(F.col("_key").isNotNull())


def last_updates(keyed: DataFrame, *order: str) -> DataFrame:
    """The last new row of each key."""
    change = F.struct(*order, "_row").alias("_change")
    return keyed.select("_key", change).groupBy("_key").agg(F.max("_change")["_row"].alias("_row"))


def replaced(rows: DataFrame, last: DataFrame, key: str = KEY) -> DataFrame:
    """Rows with all columns but the key taken from the last update of their key."""
    joined = rows.join(last, rows[key].cast("long") == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(*[col(c) if c == key else F.when(hit, F.col("_row").getField(c)).otherwise(col(c)).alias(c) for c in rows.columns])


def _filled(changes: DataFrame | None) -> bool:
    return changes is not None and not changes.isEmpty()


def apply_changes(
    base: DataFrame, inserts: DataFrame | None = None, updates: DataFrame | None = None,
    key: str = KEY, order: str = "seq", status: str = STATUS, date_removed: str = DATE_REMOVED,
) -> DataFrame:
    """The log after a change set.

    Inserted rows get the next ids in ``order``. An update replaces every
    column of its row, the last one for an id wins, it may hit a row inserted
    along with it, and an unknown id changes nothing.
    """
    has_inserts, has_updates = _filled(inserts), _filled(updates)
    if not has_inserts and not has_updates:
        raise ValueError("nothing to save")
    named = {"key": key, "order": order, "status": status, "date_removed": date_removed}
    rows = base
    if has_inserts:
        next_id = base.agg(F.coalesce(F.max(col(key)), F.lit(0)).cast("long") + 1).scalar()
        rows = base.unionByName(numbered_inserts(inserts, base, next_id, **named))
    if has_updates:
        rows = replaced(rows, last_updates(keyed_updates(updates, base, **named), "_order"), key)
    return rows


def change_counts(inserts: DataFrame | None, updates: DataFrame | None) -> dict[str, int]:
    """Numbers of requested inserts and updates, whether or not they hit a row."""
    return {
        "inserted": 0 if inserts is None else inserts.count(),
        "updated": 0 if updates is None else updates.count(),
    }


# The saved log is a base sorted by row id and, beside it, the change sets saved since:
#
#     base-<name>/       whole rows
#     added-<name>/      rows of a change set, with their ids
#     updates-<name>/    ids and new values of a change set, one row per id
#     commits/n=<version>/   one row, which names the files of a version
#
# A save writes no row of the base; reading folds the change sets in; only ``compact``
# writes a new base. Ids go on after the last one ever given, and updates beyond it are
# left out when they are saved, so no update meets a row that came later.
COMMIT = "version int, base string, base_version int, added string, updates string, last_id long, inserted long, updated long"
Commit = Row(*[part.split()[0] for part in COMMIT.split(", ")])


class SaveConflict(Exception):
    """Another writer has saved since the log was read; nothing was changed."""


def _commits(spark: SparkSession, path: str) -> list[Row]:
    """The commits from the last base on, oldest first; none if nothing was saved. Their
    number is what ``compact`` keeps small."""
    try:
        commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    last = commits.agg(F.max(F.struct("version", "base_version")).alias("last")).first()["last"]
    if last is None:
        raise ValueError(f"{path}/commits names no version")
    return commits.where((F.col("version") >= last["base_version"]) & (F.col("version") <= last["version"])).orderBy("version").collect()


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last committed version of a saved log, 0 if there is none."""
    commits = _commits(spark, path)
    return commits[-1].version if commits else 0


def _folded(spark: SparkSession, path: str, commits: Sequence[Row]) -> DataFrame:
    """The log as of the last of these commits. Without an update nothing is joined."""
    rows = spark.read.parquet(f"{path}/{commits[-1].base}")
    change = T.StructType([f for f in rows.schema.fields if f.name != KEY])
    for c in commits:
        if c.added:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/{c.added}"))
    updates = [
        spark.read.schema(T.StructType().add("_key", "long").add("_row", change)).parquet(f"{path}/{c.updates}").withColumn("_version", F.lit(c.version))
        for c in commits if c.updates
    ]
    return replaced(rows, last_updates(reduce(lambda a, b: a.unionByName(b), updates), "_version"), KEY) if updates else rows


def load_log(spark: SparkSession, path: str, original: DataFrame) -> DataFrame:
    """The saved log if it has rows, else the original import."""
    commits = _commits(spark, path)
    if commits:
        saved = _folded(spark, path, commits)
        if not saved.isEmpty():
            return saved
    return original


def load_rows(spark: SparkSession, path: str, original: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with ids from first to last. The base is sorted by id, so the test reaches its
    files and skips what it rules out."""
    return load_log(spark, path, original).where(col(KEY).between(first, last))


def _write_base(df: DataFrame, path: str) -> str:
    folder = f"base-{uuid4().hex}"
    df.repartitionByRange(col(KEY)).sortWithinPartitions(col(KEY)).write.mode("error").parquet(f"{path}/{folder}")
    return folder


def _commit(spark: SparkSession, path: str, row: Row) -> None:
    version = row.version
    try:
        # A folder per version: it exists if another writer has committed this one.
        spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("error").parquet(f"{path}/commits/n={version}")
    except AnalysisException as problem:
        raise SaveConflict(f"version {version} was saved by another writer") from problem


def save_changes(
    spark: SparkSession, path: str, original: DataFrame, inserts: DataFrame | None = None, updates: DataFrame | None = None, **options: str,
) -> dict[str, int]:
    """Applies a change set all or nothing, as ``log.apply_changes`` defines it.

    Its files become part of the log by the commit that is written last; of two writers
    that began from the same version, the second to commit fails with ``SaveConflict``.
    The first save takes the original over as the base.
    """
    has_inserts, has_updates = _filled(inserts), _filled(updates)
    if not has_inserts and not has_updates:
        raise ValueError("nothing to save")
    commits = _commits(spark, path)
    counts = change_counts(inserts, updates)
    if commits:
        before = commits[-1]
        version, base, base_version, last_id = before.version + 1, before.base, before.base_version, before.last_id
        columns = spark.read.parquet(f"{path}/{base}")
    else:
        version, base_version = 1, 1
        base = _write_base(original, path)
        columns = spark.read.parquet(f"{path}/{base}")
        last_id = columns.agg(F.max(col(KEY)).cast("long")).first()[0] or 0
    name, added, changed = uuid4().hex, None, None
    if has_inserts:
        added = f"added-{name}"
        numbered_inserts(inserts, columns, last_id + 1, **options).write.mode("error").parquet(f"{path}/{added}")
        last_id += counts["inserted"]
    if has_updates:
        changed = f"updates-{name}"
        known = keyed_updates(updates, columns, **options).where(F.col("_key") <= last_id)
        last_updates(known, "_order").write.mode("error").parquet(f"{path}/{changed}")
    _commit(spark, path, Commit(version, base, base_version, added, changed, last_id, counts["inserted"], counts["updated"]))
    return counts


def compact(spark: SparkSession, path: str) -> int:
    """Writes a new base with all change sets folded in, as a version of its own, and
    returns its number. Readers of older versions are not disturbed; nothing is deleted."""
    commits = _commits(spark, path)
    if not commits:
        raise ValueError(f"{path} holds no saved log")
    before = commits[-1]
    base = _write_base(_folded(spark, path, commits), path)
    _commit(spark, path, Commit(before.version + 1, base, before.version + 1, None, None, before.last_id, 0, 0))
    return before.version + 1
