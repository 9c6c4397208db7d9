"""Top-k selections and the top-k-plus-remainder breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_position(df: DataFrame, *order: Column, by: Sequence[str] = (), name: str = "POSITION") -> DataFrame:
    """Numbers the rows of an already limited result."""
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def top_with_other(df: DataFrame, label: str, value: str, k: int = 6) -> DataFrame:
    """Sum per label: the k largest, and one remainder row if it is positive.

    Only the k labels are broadcast; everything else is folded by an aggregate.
    """
    per_label = df.groupBy(label).agg(F.sum(value).alias("VALUE"))
    largest = top(per_label, k, F.desc_nulls_last("VALUE"), F.asc(label)).select(F.col(label).alias("_label"))
    marked = per_label.join(F.broadcast(largest), F.col(label) == F.col("_label"), "left")
    is_other = F.col("_label").isNull()
    folded = marked.groupBy(
        F.when(is_other, "Other").otherwise(F.col(label)).alias("LABEL"),
        is_other.alias("IS_OTHER"),
    ).agg(F.sum("VALUE").alias("VALUE"))
    return folded.where(~F.col("IS_OTHER") | (F.col("VALUE") > 0))
