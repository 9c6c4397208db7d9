"""What the operators of this folder share: tables, the shared folder, cut plans, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS_A_TASK = 200_000
_shipped: set[str] = set()
_vocabulary_caches: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a
    local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get(CHECKPOINT_SETTING, None)
        if not named:
            if not context.master.startswith("local["):
                raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
            named = tempfile.mkdtemp(prefix="opquality-llm-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh place below the shared folder, for files that tasks write."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computed once and written to the shared folder; lost executors cost nothing,
    and Spark removes the files when the frame is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Cut, and read by one task for so many rows: few links make few tasks and files in
    what follows, also where Spark does not merge small partitions itself. Its rows are
    counted as they are written, which takes no job of its own."""
    rows = Observation()
    out = cut(df.observe(rows, F.count(F.lit(1)).alias("rows")))
    count = rows.get["rows"]
    return out.coalesce(tasks_for(count)), count


def tasks_for(count: int) -> int:
    return max(1, -(-count // ROWS_A_TASK))


def cut_small(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


def unused(columns: list[str], *names: str) -> list[str]:
    """These names, lengthened until no column has them in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def write_parquet(df: DataFrame, purpose: str) -> DataFrame:
    """A written table in the shared folder: column-pruned and compressed when reread,
    and of a size that the planner knows."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="opquality-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/opquality-package.zip", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{folder}/opquality-package.zip")
    _shipped.add(context.applicationId)


def release_memory() -> None:
    """Gives back what arrays of finished batches held; workers live on after a task,
    beside the JVM that they share an executor's memory with."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def smaller_batches(spark: SparkSession) -> None:
    """Batches of whole texts come in pieces of 8 MiB, unless the session asks for another
    size than Spark's own 64 MiB; both the JVM and the worker hold a batch or two."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "64m", "67108864", "67108864b"):
        spark.conf.set(BATCH_SETTING, "8m")


def vocabulary_cache(function):
    """Keeps what a worker has loaded for the tasks to come, until one that has no use for it."""
    cached = lru_cache(maxsize=4)(function)
    _vocabulary_caches.append(cached)
    return cached


def forget_vocabularies() -> None:
    for cached in _vocabulary_caches:
        cached.cache_clear()


def map_arrow(df: DataFrame, function, schema, vocabularies: bool = False) -> DataFrame:
    """mapInArrow with this package at hand in the workers. Workers outlive a stage: one
    without vocabularies drops those that an earlier stage has loaded."""
    ship(df.sparkSession)
    smaller_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not vocabularies:
            forget_vocabularies()

        def one_by_one() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release_memory()

        yield from function(one_by_one())
        release_memory()

    return df.mapInArrow(lean, schema)


def per_bucket(df: DataFrame, function, schema) -> DataFrame:
    """applyInArrow over the column bucket, likewise."""
    ship(df.sparkSession)

    def lean(group: pa.Table) -> pa.Table:
        forget_vocabularies()
        out = function(group)
        release_memory()
        return out

    return df.groupBy("bucket").applyInArrow(lean, schema)
