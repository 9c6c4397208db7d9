"""Cutting the plan where one small result feeds several consumers."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session may pick its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_SETTING, None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="opquality-checkpoint-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh place in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid4().hex}"


def share(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage, so several consumers read the result
    instead of repeating the work. Meant for aggregated results, not for facts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A small table that several aggregates read, written to the shared folder when
    called and reread: computed once by construction, pruned by column, and of a size that
    the planner knows. The folder belongs to the session that set it."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
