"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, columns: list[str | Column], array: str | Column, at: str, item: str) -> DataFrame:
    """``columns`` with one row per element of ``array``, its place from 0 in ``at``; none for an empty or null array.

    An inner generator makes the optimizer copy the array into a filter below it, so an expensive array (a fold, a
    Python function) would be computed twice. The outer form is not copied.
    """
    return df.select(*columns, F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())
