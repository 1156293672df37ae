"""Token and time accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators.running import running_sums

COUNTS = ["completion_tokens", "prompt_tokens"]


def usage_by(calls: DataFrame, keys: Sequence[str], time: str = "response_time", *more: Column) -> DataFrame:
    """Field-wise sum of usages per ``keys``, beside any ``more`` aggregates; calls without a count are skipped."""
    return calls.groupBy(*keys).agg(*more, *[F.sum(c).alias(c) for c in [*COUNTS, time]]).withColumn(
        "total_tokens", F.coalesce(COUNTS[0], F.lit(0)) + F.coalesce(COUNTS[1], F.lit(0)))


def running_usage(calls: DataFrame, keys: Sequence[str], order: Sequence[str], time: str = "response_time") -> DataFrame:
    """Usage of a client up to and including every call, in ``order``."""
    running = running_sums(calls, keys, order, [*COUNTS, time])
    return running.withColumn("total_tokens", F.coalesce(COUNTS[0], F.lit(0)) + F.coalesce(COUNTS[1], F.lit(0)))
