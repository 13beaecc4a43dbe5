"""Columns that are worked out once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns. Unlike those of ``withColumn``, their expressions are not repeated wherever they are used:
    a list of one row is exploded, which conditions and later columns read."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
