"""Equi-joins of a large table with a table of chosen keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from folioscope.session import cut_lineage, fits, has_rows

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
SALTS = 64


def join_chosen(large: DataFrame, chosen: DataFrame, on: str | Sequence[str], how: str = "inner",
                salt_by: Sequence[str] = (), counted: DataFrame | None = None, max_rows: int = MAX_BROADCAST_ROWS,
                hot_rows: int = HOT_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join ``large`` with ``chosen`` on ``on``.

    ``chosen`` (or ``counted``, if that has as many rows and is cheaper to read; ``max_bytes`` is then for that) is measured
    first. Within ``max_rows`` and ``max_bytes`` it is broadcast and ``large`` is read in place. Beyond that both are shuffled; keys with more than ``hot_rows`` rows in ``large`` are then spread over ``SALTS`` tasks by the
    columns ``salt_by``, with a copy of their ``chosen`` rows in each.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits(chosen if counted is None else counted, max_rows, max_bytes):
        return large.join(F.broadcast(chosen), on, how)
    if not salt_by:
        return large.join(chosen, on, how)
    # Map-side counts, stored, as both sides ask for them; at most (rows of large / hot_rows) keys are hot, and Spark broadcasts them
    # only if they turn out small. Mostly there are none: then nothing is salted, and rows stay where a later grouping by ``on`` wants them.
    hot = cut_lineage(large.groupBy(*on).count().filter(F.col("count") > hot_rows).select(*on, F.lit(True).alias("_hot")))
    if not has_rows(hot):
        return large.join(chosen, on, how)
    spread = large.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = chosen.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return spread.drop("_hot").join(copies.drop("_hot"), [*on, "_salt"], how).drop("_salt")
