"""Texts to vectors: hashed term counts by default, any model through a hook."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.rows import unnest

WORD = r"[\p{L}\p{N}]+"
#: Texts counted at once; of a batch of long ones the words would be held several times over.
ROWS_AT_ONCE = 512


def word_buckets(text: Column, dim: int) -> Column:
    """Bucket number of every word of ``text``, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    return F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    )


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list array and the row each value belongs to."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lengths)


def _vectors(values: np.ndarray, n: int, dim: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(values.reshape(-1), pa.float32()))


def hashed_counts(text: Column, dim: int = 256) -> Column:
    """Vector of word counts per bucket. Words are split and hashed in the JVM, one ``bincount`` per Arrow batch
    makes the vectors, so a text never leaves its row and nothing is shuffled."""

    @F.arrow_udf("array<float>")
    def count(buckets: pa.Array) -> pa.Array:
        parts = [part(buckets.slice(lo, ROWS_AT_ONCE)) for lo in range(0, len(buckets), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    def part(buckets: pa.Array) -> pa.Array:
        values, rows = _rows_of(buckets)
        counts = np.bincount(rows * dim + values.astype(np.int64), minlength=len(buckets) * dim)
        return _vectors(counts, len(buckets), dim)

    return count(word_buckets(F.coalesce(text, F.lit("")), dim))


def embed(df: DataFrame, text_col: str, dim: int = 256, out: str = "embedding",
          fn: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """Add a vector column made from ``text_col``; ``fn`` turns a batch of texts into vectors of its own length."""
    if fn is None:
        return df.withColumn(out, hashed_counts(F.col(text_col), dim))

    @F.arrow_udf("array<float>")
    def model(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(float, v)) for v in fn(texts.to_pylist())], pa.list_(pa.float32()))

    return df.withColumn(out, model(F.col(text_col)))


def term_counts(df: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Non-zero cells of integer vectors as rows ``(id, bucket, tf)``."""
    cells = unnest(df, [id_col], vec_col, "bucket", "tf").filter("tf > 0")
    return cells.select(id_col, "bucket", F.col("tf").cast("bigint").alias("tf"))
