"""Keeping costly column expressions evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds or replaces a column whose expression stays where it is written.

    Filters on a projected column, also the not-null tests Spark adds for join
    keys, are rewritten into the expression and pushed down, so a long one is
    evaluated again at every level, in generated code too big for the JVM to
    compile. They are not pushed below a generator, and one over a single value
    costs next to nothing.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    added = df.select(*kept, F.explode(F.array(value)).alias(name))
    return added.select(*[F.col(f"`{c}`") for c in df.columns], *([] if name in df.columns else [name]))
