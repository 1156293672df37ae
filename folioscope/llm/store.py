"""Intermediate tables in the shared folder, and the reading of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.session import run_dir, shuffles_removed_after

#: ``[\\x20\\x09-\\x0D]``, the white space of all word and line rules.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Lineage ends here, so a lost executor costs only the tasks that read the table, and the shuffle files that led to
    it are removed at once instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    with shuffles_removed_after(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter left alone. Texts without capitals outside ASCII take the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
