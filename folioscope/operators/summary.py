"""One summary row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.hooks import Completion, complete, normalize_reply
from folioscope.functions.messages import message
from folioscope.functions.properties import merge_metadata
from folioscope.functions.text import lead_sentences

SUMMARY_SENTENCES = 8
SUMMARY_INSTRUCTIONS = (
    f"Summarize the article in at most {SUMMARY_SENTENCES} sentences, speaking for its author. Include its main points."
)


def full_text(docs: DataFrame) -> DataFrame:
    """Text of a document rebuilt from its chunks, one per line."""
    return docs.withColumn("text", F.array_join("chunks", "\n"))


def build_summary_prompt(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``messages``: the instruction and the whole text."""
    return docs.withColumn("messages", F.array(message("system", F.lit(SUMMARY_INSTRUCTIONS)), message("user", F.col(text))))


def base_metadata(*names: str):
    """The built-in keys of an index row as a map of texts."""
    pairs = [c for n in names for c in (F.lit(n), F.col(n).cast("string"))]
    return F.create_map(*pairs)


USAGE = ("completion_tokens", "prompt_tokens", "response_us")


def summarize(docs: DataFrame, fn: Completion | None = None, parallelism: int = 5, options: dict | None = None, usage: bool = False,
              log: str | None = None) -> DataFrame:
    """Summary rows ``id, metadata, document`` of ``docs`` (``id, title, last_edited_time, chunks, metadata``).

    Without ``fn`` the lead sentences stand in for the model, as a column and without Python. With ``usage`` the rows have
    the counts of their call, null without a model. Calls whose reply is in ``log`` are not made again.
    """
    texts = full_text(docs)
    if fn is None:
        answered = texts.withColumn("document", lead_sentences(F.col("text"), SUMMARY_SENTENCES))
    else:
        asked = build_summary_prompt(texts).drop("chunks", "text")
        replies = normalize_reply(complete(asked, fn, parallelism, options=options, log=log), strict=True)
        answered = replies.withColumnRenamed("reply_content", "document")
    none = F.lit(None).cast("bigint")
    counts = [(none if fn is None else F.col(c)).alias(c) for c in USAGE] if usage else []
    return answered.select("id", merge_metadata(base_metadata("title", "last_edited_time"), F.col("metadata")).alias("metadata"), "document", *counts)
