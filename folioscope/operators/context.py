"""Numbered context and prompt of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.messages import message

ANSWER_INSTRUCTIONS = (
    "Use only the numbered documents above to answer the question that follows. "
    "After each sentence give the numbers of the documents it rests on in brackets, for example [2, 3]. "
    "If the documents do not cover the question, say that you do not know. Do not cite what you have not read."
)


def number_context(shortlist: DataFrame, texts: DataFrame, qid: str = "qid") -> DataFrame:
    """Shortlisted documents that kept some text, numbered by their place in the whole shortlist (gaps stay)."""
    numbered = shortlist.withColumnRenamed("pos", "number")
    return numbered.join(texts, [qid, "doc_id"]).select(qid, "number", "doc_id", "title", "text")


def assemble_context(shortlist: DataFrame, texts: DataFrame, qid: str = "qid") -> DataFrame:
    """One context per shortlisted question; empty when the budget left none of its documents any text."""
    # The lines around a document.
    part = F.concat(F.lit("======\n document "), F.col("number").cast("string"), F.lit("\n title "),
                    F.coalesce("title", F.lit("None")), F.lit("\n "), F.col("text"), F.lit("\n"))
    parts = number_context(shortlist, texts, qid).groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct("number", part.alias("part")))).alias("_parts"))
    asked = shortlist.select(qid).distinct()
    joined = F.array_join(F.transform("_parts", lambda p: p["part"]), "\n")
    return asked.join(parts, qid, "left").select(qid, F.coalesce(joined, F.lit("")).alias("context"))


def build_prompt(contexts: DataFrame, questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """``messages``: the context, the instructions, the question."""
    return contexts.join(questions.select(qid, question), qid).select(
        qid, F.array(message("system", F.col("context")), message("system", F.lit(ANSWER_INSTRUCTIONS)),
                     message("user", F.col(question))).alias("messages"))
