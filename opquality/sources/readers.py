"""Table readers: by path or catalog name, as text, with fallbacks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opquality.sources.columns import project
from opquality.sources.snapshots import Snapshot, latest


# Conditions under which a table is not there; any other failure is passed on.
MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


def is_missing(problem: AnalysisException) -> bool:
    return (problem.getCondition() or "").startswith(MISSING)


class Catalog:
    """Names to tables: ready DataFrames first, then what was published under ``root``
    (``snapshots.py``), then parquet there, then tables or views of the session's catalog."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.tables = dict(tables or {})
        self._opened: dict[str, DataFrame] = {}
        self._snapshot: Snapshot | None = None

    @property
    def snapshot(self) -> Snapshot:
        """What was published when this catalog first looked; it stays with that."""
        if self._snapshot is None:
            self._snapshot = latest(self.spark, self.root) if self.root else Snapshot()
        return self._snapshot

    def renew(self) -> None:
        """From now on, what is published last."""
        self._snapshot = None
        self._opened.clear()

    def path(self, name: str) -> str:
        if not self.root:
            raise ValueError("this catalog has no root folder")
        return f"{self.root}/{name}"

    def read(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._find(name)
        df = self._opened[name]
        return df if columns is None else project(df, columns)

    def _find(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.root:
            if name in self.snapshot.folders:
                return self.spark.read.parquet(self.path(self.snapshot.folders[name]))
            for path in (self.path(name), self.path(name) + ".parquet"):
                try:
                    return self.spark.read.parquet(path)
                except AnalysisException as problem:
                    if not is_missing(problem):
                        raise
        return self.spark.table(name)

    def read_first_available(self, *names: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The first of several sources that exists."""
        for name in names[:-1]:
            try:
                return self.read(name, columns)
            except AnalysisException as problem:
                if not is_missing(problem):
                    raise
        return self.read(names[-1], columns)

    def read_first_nonempty(self, *names: str) -> tuple[DataFrame, str]:
        """The first source that exists and has rows, else the last one."""
        for name in names[:-1]:
            try:
                df = self.read(name)
            except AnalysisException as problem:
                if not is_missing(problem):
                    raise
                continue
            if not df.isEmpty():
                return df, name
        return self.read(names[-1]), names[-1]

    def read_or_empty(self, name: str, schema: T.StructType | str) -> DataFrame:
        """A missing table reads as an empty one."""
        try:
            return self.read(name)
        except AnalysisException as problem:
            if not is_missing(problem):
                raise
            return self.spark.createDataFrame([], schema)


def file_sizes(spark: SparkSession, files: Iterable[str]) -> dict[str, int]:
    """Bytes of these files, named as ``DataFrame.inputFiles`` does, from their listing;
    nothing of them is read. A file that is gone is left out."""
    plain = lambda path: re.sub("^file:/+", "/", path)
    named = {unquote(f): f for f in files}
    if not named:
        return {}
    # A path to read is a pattern.
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in sorted(named)]
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths).select("path", "length")
    by_path = {plain(path): f for path, f in named.items()}
    return {by_path[plain(r.path)]: r.length for r in found.collect() if plain(r.path) in by_path}


def read_text_table(spark: SparkSession, path: str, columns: Iterable[str] | None = None, **options: str) -> DataFrame:
    """Delimited file with every column kept as text (no type inference).

    Empty fields stay apart from missing ones only as far as the format does.
    """
    reader = spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"', **options)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to text."""
    from opquality.sources.columns import col

    return df.select(*[col(c).cast("string").alias(c) for c in df.columns])
