"""Vectors of an ``embeddings`` table as exact whole numbers.

A row has a vector if it is not null, not empty and holds finite numbers only; each entry ``c`` becomes ``floor(256 * c)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256.0


def is_vector(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def one_dimension(rows: DataFrame, column: str) -> int:
    """How many entries all vectors have, 0 without any; an error if they differ."""
    least, most = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries cannot be compared")
    return least or 0


def matrix(lists: pa.Array, dim: int, kind: type = np.int64) -> np.ndarray:
    """A list column of ``dim`` entries a row as a matrix."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(lists), dim)
