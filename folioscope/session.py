"""Session settings and the few helpers that look at the running session."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


INITIAL_PARTITIONS = 20_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "folioscope", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library expects; on a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Adaptive execution only merges partitions, so it starts from many unless their number is given.
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions or INITIAL_PARTITIONS))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@functools.cache
def _temporary_dir() -> str:
    return tempfile.mkdtemp(prefix="folioscope-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary one if all tasks run in this process, and an error on a cluster, whose executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        path = _temporary_dir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed_after(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go as soon as it is done instead of whenever the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def has_rows(df: DataFrame) -> bool:
    return bool(df.select().head(1))


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.NumericType, T.BooleanType)):
        return F.size(column) * 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.octet_length(F.to_json(column))
    return F.lit(8)


def fits(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes; reads no further than the rows."""
    width = sum((F.coalesce(_width(f), F.lit(0)).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))
    rows, size = df.select(width.alias("w")).limit(max_rows + 1).agg(F.count("w"), F.sum("w")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has slots; larger inputs pass unchanged."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
