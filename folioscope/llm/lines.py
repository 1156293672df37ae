"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold,
reassemble by position.

Only lines whose key is long enough are exploded, as (document, position, two 64-bit hashes); line texts are never
shuffled for the count. The distinct count is combined in the map tasks and again per (hash, document) before it meets
per hash, so a line of a third of all documents arrives reduced; the join back is one Spark may split. Texts move once,
to meet the positions they lose, and not at all where those are few enough for adaptive execution to broadcast them.

Null or empty text is one empty line. Rows without a doc_id neither count nor lose lines. Rows that repeat a doc_id count
as one document. Ties: of all documents with a line the largest doc_id keeps it, every time it holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm.store import WHITE, ascii_lower, materialize, table

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text hash, position and key hashes of the lines that may be dropped."""
    cut = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(
        "doc_id", F.xxhash64("text").alias("_text"), F.posexplode(_lines(F.col("text"))).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    return cut.where(F.length(F.btrim("_line", F.lit(WHITE))) >= min_chars).select(
        "doc_id", "_text", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes of the lines that at least ``min_docs`` documents hold, with the document that keeps each."""
    counted = lines.groupBy("_h1", "_h2").agg(F.countDistinct("doc_id").alias("_n"), F.max("doc_id").alias("_keeper"))
    return counted.where(F.col("_n") >= min_docs).select("_h1", "_h2", "_keeper")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns), ``kept`` (text left), ``n_lines``, ``n_dropped``."""
    lines = long_lines(docs, min_chars)
    dropped = (
        lines.join(materialize(shared_lines(lines, min_docs), "shared-lines"), ["_h1", "_h2"])
        .where(F.col("doc_id") != F.col("_keeper"))
        .groupBy("doc_id", "_text")
        .agg(F.array_distinct(F.collect_list("_pos")).alias("_dropped"))
        .withColumnRenamed("doc_id", "_id")
    )
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_text"), _lines(F.col("text")).alias("_lines"))
    both = cut.join(dropped, ["_id", "_text"], "left")
    n = F.size("_lines")
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_dropped"))
    left = F.when(F.col("_dropped").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda p: F.get(F.col("_lines"), p)))
    return both.select(
        "row", F.array_join(left, "\n").alias("kept"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines left in ``text`` and their length in ``n_chars``; documents left without a word go."""
    # Out of a one-row generator, so that a filter on the kept text does not put it together a second time.
    rows = dedup_lines(docs).select("row", F.inline(F.array(F.struct("kept", "n_dropped"))))
    text = F.col("kept")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    cols = [(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.where((F.col("n_dropped") == 0) | (F.btrim(text, F.lit(WHITE)) != "")).select(*cols)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line,
        translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
s AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, coalesce(l.doc_id <> s.keeper, false) AS gone FROM l LEFT JOIN s USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
