"""The given tables in the shapes the library reads. Every view covers its whole table and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions.properties import parse_properties
from folioscope.functions.rows import unnest
from folioscope.functions.text import lead_sentences, n_tokens
from folioscope.operators.embedding import embed
from folioscope.operators.packing import pack_chunks
from folioscope.plans.answer import AnswerConfig, split_queries
from folioscope.plans.ingest import LoaderConfig
from folioscope.session import run_dir, spread
from folioscope.sources.chunks import write_chunks

MAX_TOKENS = 128
CONFIG = AnswerConfig(chunk_results=2, budget=100)
FULL = AnswerConfig()
#: Unit vectors of 64 random directions have no clusters: buckets must be long to find nine in ten neighbours.
BUCKET_LENGTH = 0.12
MARK = "2024-01-15 00:00:00"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# Every block type there is, and one that is new to the library.
BLOCK_TYPES = """
bookmark breadcrumb bulleted_list_item callout child_database child_page code column column_list divider embed equation file heading_1 heading_2 heading_3
image link_preview link_to_page mention numbered_list_item paragraph pdf quote synced_block table table_of_contents table_row template to_do toggle
unsupported video new_type
""".split()


def block_type(pos: Column) -> Column:
    """Two headings, then all types in turn among list items of one or two kinds, dividers and paragraphs."""
    return (
        F.when(pos == 0, "heading_1").when(pos == 1, "heading_2").when((pos % 7 == 2) | (pos % 14 == 3), "bulleted_list_item")
        .when(pos % 14 == 10, "numbered_list_item").when(pos % 11 == 5, "divider")
        .when(pos % 3 != 0, F.get(F.array(*map(F.lit, BLOCK_TYPES)), (pos % len(BLOCK_TYPES)).cast("int"))).otherwise("paragraph")
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every document as blocks with a type each."""
    lines = unnest(documents(spark, sf), [F.col("doc_id").cast("string").alias("page_id")], F.split("text", "\n", -1), "pos", "text")
    return lines.select("page_id", "pos", block_type(F.col("pos")).alias("btype"), "text", n_tokens(F.col("text")).alias("n_tokens"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a page with properties, edited a minute after the one before: ``page_id, last_edited, properties``."""
    at = F.timestamp_seconds(F.lit(1_709_251_200) + F.col("page_id").cast("bigint") * 60)
    return described(spark, sf).select("page_id", at.alias("last_edited"), "properties")


def rich_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks as the source has them, before their text is read."""
    text = F.array(F.struct(F.col("text").alias("plain_text")))
    return blocks(spark, sf).select("page_id", "pos", "btype", text.alias("rich_text"), F.lit(None).cast("array<string>").alias("caption"), F.lit(None).cast("string").alias("expression"))


def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as a source has them: a table, whose rows are not made again by every read of an ingest run."""
    return stored(spark, sf, "pages", pages, _pressed)


def stored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``rich_blocks`` as a table."""
    return stored(spark, sf, "rich_blocks", rich_blocks, _pressed)


def _pressed(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a log of page edits."""
    return table(spark, sf, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("edit_id"),
                                             F.col("ts").alias("last_edited"), F.col("event_type").alias("title"), "value")


def mark() -> Column:
    return F.to_timestamp_ntz(F.lit(MARK))


def described(spark: SparkSession, sf: str) -> DataFrame:
    """A property bag per document, read back from JSON: ``page_id, properties``."""
    bag = spark.sql(r"""
        SELECT CAST(doc_id AS STRING) AS page_id, to_json(named_struct(
          'Title', named_struct('type', 'title', 'title', transform(slice(regexp_extract_all(text, r'\S+', 0), 1, 2), x -> named_struct('plain_text', x))),
          'Source', named_struct('type', 'rich_text', 'rich_text', array(named_struct('plain_text', source), named_struct('plain_text', lang))),
          'Related', named_struct('type', 'relation', 'relation', array(named_struct('id', (doc_id + 1) % n_docs), named_struct('id', (doc_id + 2) % n_docs))),
          'Edited', named_struct('type', 'last_edited_time', 'last_edited_time', concat('2024-02-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'))),
          'Date', named_struct('type', 'date', 'date', if(doc_id % 5 = 0, null, named_struct('start', concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'))))),
          'Files', named_struct('type', 'files', 'files', array(source)))) AS properties
        FROM (SELECT *, (SELECT count(*) FROM {counted}) AS n_docs FROM {docs})""", docs=documents(spark, sf), counted=table(spark, sf, "documents"))
    return bag.select("page_id", parse_properties(F.col("properties")).alias("properties"))


def titled(docs: DataFrame) -> DataFrame:
    """Add the title of a document: its first two words."""
    return docs.withColumn("title", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), 0), 1, 2), " "))


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame],
           write: Callable[[DataFrame, str], None] = lambda df, path: df.write.parquet(path)) -> DataFrame:
    """An index over the tables in ``sf``: built and written by the first query of an application that asks for it, as
    an index is built once and searched often. Every build has its own folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = run_dir(spark, name)
        write(build(spark, sf), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def summary_index(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "summary_index", build_summary_index)


def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "chunk_index", build_chunk_index, write_chunks)


def chunk_index_full(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the default size."""
    return stored(spark, sf, "chunk_index_full", lambda s, f: build_chunk_index(s, f, LoaderConfig.max_tokens), write_chunks)


def build_summary_index(spark: SparkSession, sf: str) -> DataFrame:
    """``id, title, document, embedding`` with the lead sentences of every document as its summary."""
    docs = titled(documents(spark, sf)).select(F.col("doc_id").alias("id"), "title", lead_sentences(F.col("text")).alias("document"))
    return embed(docs, "document")


def chunk_rows(spark: SparkSession, sf: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    packed = pack_chunks(blocks(spark, sf), max_tokens)
    return packed.select(F.concat_ws("_", "page_id", "chunk_id").alias("id"), F.col("page_id").cast("bigint").alias("doc_id"),
                         "chunk_id", F.col("text").alias("document"))


def build_chunk_index(spark: SparkSession, sf: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``id, doc_id, chunk_id, document, n_tokens, embedding`` of all documents."""
    return embed(chunk_rows(spark, sf, max_tokens).withColumn("n_tokens", n_tokens(F.col("document"))), "document")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Search queries of every question: its sentences, in the form of a reply."""
    replies = questions(spark, sf).select("qid", F.replace("question", F.lit(". "), F.lit(";")).alias("reply"))
    return split_queries(replies)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """A model call per turn of the conversations."""
    answers = F.col("role") == "assistant"
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("qid"), "turn", F.when(answers, "m1").otherwise("m0").alias("model"),
        F.when(answers, F.length("text")).otherwise(0).cast("bigint").alias("completion_tokens"),
        F.when(answers, 0).otherwise(F.length("text")).cast("bigint").alias("prompt_tokens"),
        (F.length("text").cast("bigint") * 1000).alias("response_us"))
