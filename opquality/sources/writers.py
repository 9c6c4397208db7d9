"""Whole-table writes and JSON row export."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.functions.numbers import nan_to_null
from opquality.sources.columns import col

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Puts a finished folder in the place of another, by renaming within one store."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path(f"{target}.old-{uuid4().hex}")
    had_one = store.exists(path(target))
    if had_one and not store.rename(path(target), old):
        raise OSError(f"cannot set aside {target}")
    if not store.rename(path(source), path(target)):
        if had_one:
            store.rename(old, path(target))
        raise OSError(f"cannot put {source} in the place of {target}")
    if had_one:
        store.delete(old, True)


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Readers meet the old table until the new one is written, and a failed job leaves
    the old one as it was."""
    beside = f"{path}.{uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(beside)
    replace_folder(df.sparkSession, beside, path)


def _json_value(field: T.StructField) -> Column:
    value = col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, TIMESTAMP_FORMAT).alias(field.name)
    return nan_to_null(value, field.dataType).alias(field.name)


def json_records(df: DataFrame, name: str = "RECORD") -> DataFrame:
    """One JSON text per row; missing values are written as null."""
    record = F.struct(*[_json_value(f) for f in df.schema.fields])
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    json_records(df, "value").write.mode("overwrite").text(path)
