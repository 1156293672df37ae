"""Token counts kept by deltas: totals by source, language and tokenizer version.

A change is a signed row: +1 for a document that comes, -1 for one that goes, both for one whose count is revised. A batch
of changes is summed per key before it is stored, so a batch costs as much as it changes and totals are plain sums over
batches. A batch counts once its id is in the table of commits, to which it is appended after its sums are written:
committing an id again changes nothing, and a batch that failed halfway is not read and is written anew.

Null text counts no tokens but is a document; null source or language is a key of its own. Keys whose documents all
went have no row. Rows that repeat a doc_id are counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm.bpe import Encoder
from folioscope.llm.packing import tokenizer_path
from folioscope.llm.store import materialize, table
from folioscope.session import run_dir

KEY = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
VERSION = "byte_bpe_50k-1"
#: The version that documents come in with: every byte is a token.
BYTES_VERSION = "utf8_bytes-1"


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_bytes and a hash of the text, one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            n = pa.array((len(encoder.encode(t.as_py() or "")) for t in batch.column("text")), pa.int64(), size=batch.num_rows)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), n], names=[*rest, "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2"))
    schema = "doc_id long, source string, lang string, n_bytes long, _h1 long, _h2 long, n_tokens long"
    return rows.mapInArrow(count, schema).withColumn("tokenizer", F.lit(version))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deleted(counts: DataFrame) -> DataFrame:
    return inserted(counts).select(*KEY, *((-F.col(c)).alias(c) for c in SUMS))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """The old counts withdrawn and the new ones added, whatever in them changed: tokenizer, language, source or count."""
    return deleted(before).unionByName(inserted(after))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str, batch: str) -> bool:
    return bool(_stored(spark, f"{folder}/commits", "batch string").where(F.col("batch") == batch).head(1))


def commit(changes: DataFrame, folder: str, batch: str) -> bool:
    """Add a batch of signed rows to the rollup; false if the batch is there already. One writer at a time."""
    spark = changes.sparkSession
    if committed(spark, folder, batch):
        return False
    sums = changes.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))
    sums.where(" or ".join(f"{c} <> 0" for c in SUMS)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return True


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over the committed batches; keys without documents, tokens and bytes are left out."""
    deltas = _stored(spark, f"{folder}/deltas", f"{DELTA_SCHEMA}, batch string")
    done = _stored(spark, f"{folder}/commits", "batch string").distinct()
    rows = deltas.join(done, "batch", "left_semi")
    return rows.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS))


def exact_copies(counts: DataFrame) -> DataFrame:
    """Rows whose text a row with a smaller doc_id has, by two 64-bit hashes. Hot texts arrive reduced to their smallest id."""
    first = counts.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = materialize(first, "copied-texts")
    return counts.join(first, ["_h1", "_h2"]).where(F.col("doc_id") > F.col("_first"))


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document comes in counted in bytes, all counts are revised to the tokenizer, then exact copies go: tokens of
    distinct texts by source, language and tokenizer.

    Every batch is offered twice, as a retried job would.
    """
    counts = materialize(counted(table(spark, sf_dir, "documents"), tokenizer_path(), VERSION), "token-counts")
    before = counts.withColumn("n_tokens", F.col("n_bytes")).withColumn("tokenizer", F.lit(BYTES_VERSION))
    folder = run_dir(spark, "token-rollup")
    for batch, changes in (("load", inserted(before)), ("revise", revised(before, counts)), ("copies", deleted(exact_copies(counts)))):
        commit(changes, folder, batch)
        commit(changes, folder, batch)
    return totals(spark, folder)
