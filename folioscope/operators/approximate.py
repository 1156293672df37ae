"""Approximate nearest rows by random projections, under a name of their own; ``knn`` stays exact and is what everything else uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from folioscope.operators.knn import is_vector, nearest
from folioscope.session import cut_lineage

TABLES = 8
SEED = 17


def approximate_knn(index: DataFrame, queries: DataFrame, bucket_length: float, k: int = 20, keys: Sequence[str] = ("qid", "qpos"), id_col: str = "id",
                    vec_col: str = "embedding", query_col: str = "qvec", carry: Sequence[str] = (), tables: int = TABLES) -> DataFrame:
    """Up to ``k`` near index rows of every query: ``keys, rank, id, distance, carry``, like ``knn``.

    Rows meet where they fall into one bucket of ``bucket_length`` on one of ``tables`` random lines; candidates are ranked by
    their exact distance, ties on id. What shares no bucket with a question is missed: longer buckets and more tables find
    more and compare more. A question may have fewer than ``k`` rows. Rows without a usable vector are left out.
    """
    index = index.select(id_col, vec_col, *carry).where(is_vector(F.col(vec_col)) & F.col(id_col).isNotNull())
    asked = cut_lineage(queries.select(*keys, query_col).dropna(subset=list(keys))).where(is_vector(F.col(query_col)))
    if not asked.head(1):
        return index.join(asked, F.lit(False)).select(*keys, F.lit(1).alias("rank"), id_col, F.lit(0.0).alias("distance"), *carry)
    lines = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=SEED)
    model = lines.fit(asked.select(array_to_vector(query_col).alias("_v")))  # only the length of the vectors is learned

    def buckets(rows: DataFrame, vector: str) -> DataFrame:
        hashed = model.transform(rows.withColumn("_v", array_to_vector(vector)))
        return hashed.withColumn("_buckets", F.transform("_h", lambda b: F.get(vector_to_array(b), F.lit(0)))).drop("_v", "_h")

    # Long buckets hold a large part of all pairs, so pairs are met in place, as by ``knn``, and never stored or shuffled.
    return nearest(buckets(index, vec_col), buckets(asked, query_col), k, keys, id_col, vec_col, query_col, carry, bucket_col="_buckets")


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str] = ("qid", "qpos"), id_col: str = "id") -> DataFrame:
    """``keys, n_exact, n_found``: how many of the exact rows of every question were found."""
    hit = found.select(*keys, id_col, F.lit(1).alias("_hit"))
    return exact.select(*keys, id_col).join(hit, [*keys, id_col], "left").groupBy(*keys).agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"))
