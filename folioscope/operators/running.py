"""Running sums whose groups may be larger than one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from folioscope.session import cut_lineage


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` by their running sums per ``keys`` in ``order`` (which must name every row once).

    A window per key would put a whole key into one task. Rows are range-partitioned by ``order`` instead: sums inside
    a range, plus what the earlier ranges of the key add up to, which is one row per key and range. The ranges are
    written to the checkpoint folder, so that a repeated task sees the same ones.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = totals.select(*keys, "_range", *[F.sum(c).over(before).alias(f"_before_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({c: F.sum(c).over(inside) for c in columns}).join(offsets, [*keys, "_range"])
    # Either part is null only while every value so far was null.
    return summed.withColumns({
        c: F.coalesce(F.col(c) + F.col(f"_before_{c}"), F.col(c), F.col(f"_before_{c}")) for c in columns
    }).drop("_range", *[f"_before_{c}" for c in columns])
