"""One pointer over all tables of a run.

A run writes its tables into folders of its own, ``runs/<run>/<table>``, and publishes them
by one small file, ``snapshots/n=<number>``, that names the folder of every table. A reader
that has read the pointer goes on with the folders it names, so it meets one run throughout,
whatever is published meanwhile; until then it meets the run before. Nothing is renamed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "number int, name string, run string, folder string"


class SnapshotConflict(Exception):
    """Another run has published since this one began; its tables are not published."""


@dataclass(frozen=True)
class Snapshot:
    """number 0 is the state before anything was published."""

    number: int = 0
    folders: Mapping[str, str] = field(default_factory=dict)
    runs: Mapping[str, str] = field(default_factory=dict)


def latest(spark: SparkSession, root: str) -> Snapshot:
    """What the last published pointer names: one row per table."""
    try:
        pointers = spark.read.schema(SNAPSHOT).parquet(f"{root}/snapshots")
    except AnalysisException as problem:
        if (problem.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return Snapshot()
        raise
    last = pointers.agg(F.max("number")).first()[0]
    if last is None:
        raise ValueError(f"{root}/snapshots names no run")
    rows = pointers.where(F.col("number") == last).collect()
    return Snapshot(last, {r["name"]: r["folder"] for r in rows}, {r["name"]: r["run"] for r in rows})


def run_folder(run: str, name: str) -> str:
    return f"runs/{run}/{name}"


def publish(spark: SparkSession, root: str, run: str, names: list[str], since: Snapshot) -> Snapshot:
    """Makes the tables of a run current, in one step. Tables that it has not built stay
    as ``since`` has them. Of two runs that began from one snapshot the second fails."""
    folders = {**since.folders, **{n: run_folder(run, n) for n in names}}
    runs = {**since.runs, **{n: run for n in names}}
    number = since.number + 1
    rows = [(number, n, runs[n], folders[n]) for n in sorted(folders)]
    try:
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("error").parquet(f"{root}/snapshots/n={number}")
    except AnalysisException as problem:
        raise SnapshotConflict(f"snapshot {number} was published by another run") from problem
    return Snapshot(number, folders, runs)
