"""Tables stored in buckets of a key, so that work per key needs no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from opquality.sources.columns import col


def write_bucketed(df: DataFrame, path: str, key: str, sort_by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Writes the rows dealt by the hash of ``key`` into so many buckets, one file each,
    sorted by key and ``sort_by``, and returns the table. Rows are shuffled here, once."""
    dealt = df.repartition(buckets, col(key)).sortWithinPartitions(col(key), *[col(c) for c in sort_by])
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *sort_by).option("path", path).saveAsTable(f"bucketed_{uuid4().hex}")
    return read_bucketed(df.sparkSession, path, key, sort_by, buckets)


def read_bucketed(spark: SparkSession, path: str, key: str, sort_by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Such a table, from its files; any session can say how they are dealt."""
    name = f"bucketed_{uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    order = ", ".join(f"`{c}`" for c in (key, *sort_by))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
