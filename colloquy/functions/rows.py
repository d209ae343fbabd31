"""One-row tables as values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery: it runs
    once and its values travel as literals. An empty table gives NULLs, a second row is
    an error."""
    packed = one.select(F.struct(*one.columns).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(
        *df.columns, *[F.col(f"_row.{c}").alias(c) for c in one.columns])
