"""The chunk index on disk: partitioned by a hash of the document, so that a lookup of some documents reads their partitions only.

The partition column carries the number of partitions in its name (``part_64``), which makes a stored index self-describing: a
lookup knows from the table alone where a document lies. Inside a partition rows are sorted by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

PARTS = 64
_PART = re.compile(r"part_(\d+)")


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.hash(doc_id), F.lit(parts))


def part_column(chunks: DataFrame) -> str | None:
    """Name of the partition column, if the index has one."""
    return next((c for c in chunks.columns if _PART.fullmatch(c)), None)


def write_chunks(chunks: DataFrame, path: str, parts: int = PARTS) -> None:
    """Store ``chunks`` (``id, doc_id, ...``) by document. A partition that outgrows a task is split by the rebalancing hint."""
    column = f"part_{parts}"
    placed = chunks.withColumn(column, part_of(F.col("doc_id"), parts)).hint("rebalance", column)
    placed.sortWithinPartitions(column, "doc_id").write.partitionBy(column).parquet(path)


def located(chunks: DataFrame, documents: DataFrame, on: str = "doc_id", counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The partitions of ``chunks`` that hold ``documents`` (all of an index without partitions), ``documents`` with the
    partition each lies in, and the columns to look them up by.

    The partitions that occur are asked for first (from ``counted``, if that has the same documents and is cheaper to read): a
    list no longer than the number of partitions, which the scan of the index gets as its partition filter.
    """
    column = part_column(chunks)
    if column is None:
        return chunks, documents, [on]
    parts = int(_PART.fullmatch(column).group(1))
    place = part_of(F.col(on).cast(chunks.schema[on].dataType), parts).cast(chunks.schema[column].dataType)
    asked = documents if counted is None else counted
    numbers = [r[0] for r in asked.where(F.col(on).isNotNull()).select(place.alias(column)).distinct().collect()]
    return chunks.where(F.col(column).isin(numbers) if numbers else F.lit(False)), documents.withColumn(column, place), [column, on]
